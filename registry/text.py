"""Operators over text columns, repair of spelling, versions and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.number_words import NUMBER_WORDS
from quillgrid.operators import text as N
from quillgrid.operators.scoring import score_predictions
from quillgrid.sources.ingest import value_dictionary
from registry.base import over, register, sql_strip, table, view


def _sql_label(text: str) -> str:
    t = f"coalesce(lower({sql_strip(text)}), '')"
    whens = []
    for rule in N.RULES:
        fits = " AND ".join(
            [f"regexp_matches({t}, '{p}')" for p in rule.needs] + [f"NOT regexp_matches({t}, '{p}')" for p in rule.unless]
        )
        if isinstance(rule.label, dict):
            word = f"regexp_extract({t}, '(?:^|{N.NOT_WORD})({'|'.join(rule.label)})(?:$|{N.NOT_WORD})', 1)"
            value = f"CASE {word} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rule.label.items()) + " END"
        else:
            value = f"'{rule.label}'"
        whens.append(f"WHEN {fits} THEN {value}")
    return "CASE " + "\n".join(whens) + f" ELSE '{N.NO_RULE}' END"


@register("label_by_rules", over("requests", f"SELECT _rid, label AS expected, {_sql_label('text')} AS label FROM requests"))
def label_by_rules(spark, folder):
    requests = view(spark, folder, "requests").withColumnRenamed("label", "expected")
    return N.label_by_rules(requests, "text").select("_rid", "expected", "label")


@register("label_by_rules_documents", f"SELECT doc_id, {_sql_label('text')} AS label FROM documents")
def label_by_rules_documents(spark, folder):
    return N.label_by_rules(table(spark, folder, "documents"), "text").select("doc_id", "label")


# The prototype of a label is the mean of its vectors.
@register(
    "nearest_prototype",
    """WITH cells AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
       means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY label, i),
       protos AS (SELECT label, list(m ORDER BY i) AS p FROM means GROUP BY label),
       scored AS (SELECT e.vec_id, CAST(p.label AS VARCHAR) AS label,
                  list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), p.p) AS s FROM embeddings e, protos p),
       best AS (SELECT vec_id, label, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM scored)
       SELECT vec_id, CASE WHEN s > 0.35 THEN label END AS label, round_even(s, 6) AS score FROM best WHERE r = 1""",
)
def nearest_prototype(spark, folder):
    vectors = table(spark, folder, "embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    prototypes = means.groupBy(F.col("label").cast("string").alias("label")).agg(
        F.transform(ordered, lambda c: c["m"]).alias("vector")
    )
    scored = N.nearest_prototype(vectors.drop("label"), "embedding", prototypes)
    return scored.select("vec_id", "label", F.bround("score", 6).alias("score"))


@register(
    "nearest_prototype_many",
    """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       p AS (SELECT CAST(vec_id AS VARCHAR) AS label, list_concat(v[2:], v[1:1]) AS v FROM q),
       scored AS (SELECT vec_id, label, list_cosine_similarity(q.v, p.v) AS s FROM q, p),
       best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM scored)
       SELECT vec_id, CASE WHEN s > 0.35 THEN label END AS label, round_even(s, 6) AS score FROM best WHERE r = 1""",
)
def nearest_prototype_many(spark, folder):
    """Every vector against all vectors turned by one place, searched by groups."""
    vectors = table(spark, folder, "embeddings").drop("label")
    turned = F.concat(F.slice("embedding", F.lit(2), F.size("embedding")), F.slice("embedding", 1, 1))
    prototypes = vectors.select(F.col("vec_id").cast("string").alias("label"), turned.alias("vector"))
    scored = N.nearest_prototype(vectors, "embedding", prototypes, most=100)
    return scored.select("vec_id", "label", F.bround("score", 6).alias("score"))


def _numbers_sql(table_name, key):
    return f"""SELECT {key}, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS position, TRY_CAST(unnest(l) AS DOUBLE) AS number
               FROM (SELECT {key}, regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*') AS l FROM {table_name})"""


@register("extract_numbers", _numbers_sql("documents", "doc_id"))
def extract_numbers(spark, folder):
    return N.extract_numbers(table(spark, folder, "documents"), "text", ["doc_id"])


@register("extract_numbers_requests", over("requests", _numbers_sql("requests", "_rid")))
def extract_numbers_requests(spark, folder):
    return N.extract_numbers(view(spark, folder, "requests"), "text", ["_rid"])


_MAP = "MAP {" + ", ".join(f"'{w}': CAST({v} AS DOUBLE)" for w, v in NUMBER_WORDS.items()) + "}"
_PAIR = """CASE WHEN a IS NULL OR b IS NULL THEN coalesce(a, b) WHEN a >= 1000 THEN NULL WHEN b >= 1000 THEN a * b
           WHEN a = 100 OR b = 100 THEN a * b ELSE a + b END"""


def _word_numbers_sql(source, key):
    return f"""
    WITH w AS (SELECT {key}, text, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
                 lambda x: regexp_full_match(x, '[a-z]+')) AS words FROM {source}),
    t AS (SELECT {key}, text, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
    v AS (SELECT {key}, text, i, word, nums[word] AS a FROM t, (SELECT {_MAP} AS nums)),
    n AS (SELECT {key}, text, i, word, a, lead(a) OVER (PARTITION BY {key} ORDER BY i) AS b,
            lead(word) OVER (PARTITION BY {key} ORDER BY i) AS following FROM v),
    c AS (SELECT {key}, text, 2 * i AS o, a AS number FROM n
          UNION ALL SELECT {key}, text, 2 * i + 1, CASE WHEN word = 'point' THEN CASE WHEN b < 10 THEN b / 10 END
            WHEN following IS NOT NULL THEN {_PAIR} END FROM n),
    f AS (SELECT {key}, number, min(o) AS o, any_value(text) AS text FROM c WHERE number > 0 GROUP BY {key}, number)
    SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY o) AS INTEGER) AS position, number FROM f
    WHERE NOT list_contains(list_transform(regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*'), lambda x: TRY_CAST(x AS DOUBLE)), number)"""


@register("extract_word_numbers", over("requests", _word_numbers_sql("requests", "_rid")))
def extract_word_numbers(spark, folder):
    return N.extract_word_numbers(view(spark, folder, "requests"), "text", ["_rid"])


_SPOKEN = """(SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' and forty two of them' WHEN 1 THEN ' for three hundred thousand a year'
    WHEN 2 THEN ' the salary of one team' ELSE ' any price' END) AS text FROM {documents})"""


def _spoken(spark, folder):
    return spark.sql(f"SELECT * FROM {_SPOKEN}", documents=table(spark, folder, "documents"))


_SPOKEN_SQL = _SPOKEN.replace("{documents}", "documents")


@register("extract_word_numbers_documents", _word_numbers_sql(_SPOKEN_SQL, "doc_id"))
def extract_word_numbers_documents(spark, folder):
    return N.extract_word_numbers(_spoken(spark, folder), "text", ["doc_id"])


_OPS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.COMPARISONS.items()) + "}"


def _comparisons_sql(source, key):
    t = "regexp_replace(lower(text), '[_\\-]+', ' ', 'g')"
    ex = [f"regexp_extract_all({t}, '{N.COMPARISON}', {i})" for i in (1, 2, 3)]
    return f"""
    WITH h AS (SELECT {key}, {ex[0]} AS o, {ex[1]} AS v, {ex[2]} AS s FROM {source}),
    e AS (SELECT {key}, unnest(range(1, len(o) + 1)) AS position, unnest(o) AS o, unnest(v) AS v, unnest(s) AS s FROM h),
    w AS (SELECT *, nums, list_filter(list_transform(regexp_split_to_array(v, '[ -]+'), lambda x: nums[x]),
            lambda x: x IS NOT NULL) AS n FROM e, (SELECT {_MAP} AS nums)),
    p AS (SELECT *, n[1] AS a, n[2] AS b, n[3] AS c FROM w)
    SELECT {key}, CAST(position AS INTEGER) AS position, ({_OPS})[o] AS operator,
      (CASE WHEN regexp_matches(v, '^-?[0-9]') THEN TRY_CAST(replace(v, ',', '') AS DOUBLE)
            WHEN len(n) <= 2 THEN CASE WHEN len(n) = 0 THEN NULL ELSE {_PAIR} END
            WHEN a >= 1000 OR (b >= 1000 AND c >= 1000) THEN NULL
            WHEN b >= 1000 THEN a * b + c
            WHEN c >= 1000 THEN (CASE WHEN a = 100 OR b = 100 THEN a * b ELSE a + b END) * c
            ELSE a * b + c END)
      * CASE WHEN lower(s) IN ('k', 'thousand') THEN 1000 WHEN lower(s) IN ('m', 'million') THEN 1000000 ELSE 1 END AS number
    FROM p"""


@register("extract_comparisons", over("requests", _comparisons_sql("requests", "_rid")))
def extract_comparisons(spark, folder):
    return N.extract_comparisons(view(spark, folder, "requests"), "text", ["_rid"])


@register("extract_comparisons_documents", _comparisons_sql("documents", "doc_id"))
def extract_comparisons_documents(spark, folder):
    return N.extract_comparisons(table(spark, folder, "documents"), "text", ["doc_id"])


_EDGES = "' ' || chr(9) || chr(13) || chr(10) || ',;.'"


def _steps_sql(source, key):
    separator = r"(?i)\b(?:then|and then|after that|and next|followed by|afterwards|also)\b|;"
    dangling = r"(?:\s+\b(?:and|then)\b)+\s*$"
    return f"""
    WITH p AS (SELECT {key}, text, list_filter(list_transform(regexp_split_to_array(text, '{separator}'),
        lambda x: trim(regexp_replace({sql_strip('x')}, '{dangling}', '', 'gi'), {_EDGES})), lambda x: length(x) >= 3) AS l FROM {source}),
    s AS (SELECT {key}, CASE WHEN len(l) > 0 THEN l ELSE [{sql_strip('text')}] END AS l FROM p)
    SELECT {key}, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS step, unnest(l) AS query FROM s"""


@register("split_steps", over("requests", _steps_sql("requests", "_rid")))
def split_steps(spark, folder):
    return N.split_steps(view(spark, folder, "requests"), "text", ["_rid"])


@register("split_steps_conversations", _steps_sql("conversations", "conv_id, turn"))
def split_steps_conversations(spark, folder):
    return N.split_steps(table(spark, folder, "conversations"), "text", ["conv_id", "turn"])


# Dictionary: event types (single words) and part names (two words).
_WB = r"(?:^|[^\p{L}\p{N}_])"
_WE = r"(?:$|[^\p{L}\p{N}_])"


def _tags_sql(source, key, dictionary):
    # A value stands alone where the text, cut at the value, has no word
    # character at the cut; it is negated when a negation word comes before.
    words = r"list_filter(regexp_extract_all({x}, '(?:[\p{{L}}\p{{N}}_]|'')+'), lambda w: length(w) >= 3)"
    before = rf"{_WB}(?:{N.NEGATION})(?:[^\p{{L}}\p{{N}}_]|[^\p{{L}}\p{{N}}_].*[^\p{{L}}\p{{N}}_])$"
    return f"""
    WITH texts AS (SELECT {key} AS id, regexp_replace(lower(text), '[_\\-]+', ' ', 'g') AS t FROM {source} WHERE text IS NOT NULL),
    dict AS (SELECT DISTINCT "column", lower({sql_strip('value')}) AS value FROM ({dictionary})),
    pairs AS (SELECT t, "column", value, string_split(t, value) AS cut, {words.format(x='t')} AS tw, {words.format(x='value')} AS vw
              FROM (SELECT DISTINCT t FROM texts), dict),
    spots AS (SELECT t, "column", value, tw, vw, list_filter(list_transform(range(1, len(cut)),
                lambda i: CASE WHEN NOT regexp_matches(cut[i], '[\\p{{L}}\\p{{N}}_]$') AND NOT regexp_matches(cut[i + 1], '^[\\p{{L}}\\p{{N}}_]')
                               THEN substr(t, 1, CAST(list_sum(list_transform(cut[1:i], lambda c: length(c))) AS BIGINT) + (i - 1) * length(value)) END), lambda x: x IS NOT NULL) AS starts FROM pairs),
    marked AS (SELECT t, "column", value, len(starts) > 0 AS whole, list_has_any(tw, vw) AS loose,
                len(list_filter(starts, lambda x: regexp_matches(x, '{before}'))) > 0 AS neg FROM spots),
    hits AS (SELECT t, "column", value, neg, 'whole' AS matched FROM marked WHERE whole
             UNION ALL SELECT t, "column", value, neg, 'word' FROM marked WHERE loose AND t NOT IN (SELECT t FROM marked WHERE whole)),
    tags AS (SELECT t, "column", CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, matched,
               CASE WHEN count(DISTINCT value) = 1 THEN bool_or(neg) END AS negated, count(DISTINCT value) > 1 AS conflict
             FROM hits GROUP BY t, "column", matched)
    SELECT id AS {key}, "column", value, matched, negated, conflict FROM texts JOIN tags USING (t)"""


@register(
    "tag_dictionary_values",
    over("requests", _tags_sql("requests", "_rid", "SELECT DISTINCT 'event_type' AS \"column\", event_type AS value FROM events")),
)
def tag_dictionary_values(spark, folder):
    dictionary = value_dictionary(table(spark, folder, "events"), ["event_type"])
    return N.tag_dictionary_values(view(spark, folder, "requests"), "text", "_rid", dictionary)




@register(
    "tag_dictionary_values_parts",
    _tags_sql(
        "(SELECT p_partkey, CASE WHEN p_size > 25 THEN 'not the ' || replace(p_name, ' ', '_') ELSE 'a gizmo or ' || p_type END || ', size ' || CAST(p_size AS VARCHAR) AS text FROM part)",
        "p_partkey",
        "SELECT 'p_name' AS \"column\", p_name AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_brand', p_brand FROM part",
    ),
)
def tag_dictionary_values_parts(spark, folder):
    parts = table(spark, folder, "part")
    start = F.when(
        F.col("p_size") > 25, F.concat(F.lit("not the "), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    ).otherwise(F.concat(F.lit("a gizmo or "), F.col("p_type")))
    texts = parts.select("p_partkey", F.concat(start, F.lit(", size "), F.col("p_size").cast("string")).alias("text"))
    return N.tag_dictionary_values(texts, "text", "p_partkey", value_dictionary(parts, ["p_name", "p_type", "p_brand"]))


def _sorted_words(x):
    return rf"list_aggregate(list_sort(regexp_extract_all(lower(regexp_replace({x}, '[_\-]+', ' ', 'g')), '[a-z0-9]+')), 'string_agg', ' ')"


_SIM = "100.0 * (1.0 - levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE))"


@register(
    "fuzzy_lookup",
    over(
        "dirty_customer",
        f"""WITH a AS (SELECT DISTINCT segment AS value, {_sorted_words('segment')} AS k FROM dirty_customer WHERE segment IS NOT NULL),
            b AS (SELECT DISTINCT c_mktsegment AS match, {_sorted_words('c_mktsegment')} AS k FROM customer),
            s AS (SELECT a.value, b.match, {_SIM} AS score FROM a, b WHERE a.k <> '' AND b.k <> ''),
            r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC) AS r,
                  lead(score, 1, 0) OVER (PARTITION BY value ORDER BY score DESC) AS second FROM s)
            SELECT value, match, round_even(score, 4) AS score FROM r WHERE r = 1 AND score >= 88 AND score - second >= 6""",
    ),
)
def fuzzy_lookup(spark, folder):
    customers = view(spark, folder, "dirty_customer")
    return N.fuzzy_lookup(customers, "segment", table(spark, folder, "customer"), "c_mktsegment")


@register(
    "fuzzy_candidates",
    over(
        "dirty_customer",
        """WITH a AS (SELECT DISTINCT segment AS value, lower(segment) AS k FROM dirty_customer WHERE segment IS NOT NULL),
           b AS (SELECT DISTINCT c_mktsegment AS match, lower(c_mktsegment) AS k FROM customer),
           p AS (SELECT a.value, b.match, CASE WHEN a.k = b.k THEN 'exact'
                   WHEN length(a.k) >= 3 AND length(b.k) >= 3 AND (contains(a.k, b.k) OR contains(b.k, a.k)) THEN 'part'
                   WHEN length(a.k) >= 3 AND levenshtein(a.k, b.k) * 100 <= 30 * greatest(length(a.k), length(b.k)) THEN 'similar' END AS how
                 FROM a, b)
           SELECT * FROM p WHERE how IS NOT NULL""",
    ),
)
def fuzzy_candidates(spark, folder):
    customers = view(spark, folder, "dirty_customer")
    return N.fuzzy_candidates(customers, "segment", table(spark, folder, "customer"), "c_mktsegment")


@register(
    "fuzzy_candidates_parts",
    """WITH a AS (SELECT DISTINCT p_name AS value, lower(p_name) AS k FROM part),
       b AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS match, lower(split_part(p_name, ' ', 2)) AS k FROM part
             UNION SELECT DISTINCT p_name, lower(p_name) FROM part),
       p AS (SELECT a.value, b.match, CASE WHEN a.k = b.k THEN 'exact'
               WHEN length(a.k) >= 3 AND length(b.k) >= 3 AND (contains(a.k, b.k) OR contains(b.k, a.k)) THEN 'part'
               WHEN length(a.k) >= 3 AND levenshtein(a.k, b.k) * 100 <= 30 * greatest(length(a.k), length(b.k)) THEN 'similar' END AS how
             FROM a, b)
       SELECT * FROM p WHERE how IS NOT NULL""",
)
def fuzzy_candidates_parts(spark, folder):
    parts = table(spark, folder, "part")
    nouns = parts.select(F.split("p_name", " ")[1].alias("entry"))
    return N.fuzzy_candidates(parts, "p_name", nouns.unionByName(parts.select(F.col("p_name").alias("entry"))), "entry")


def _fields_sql(text):
    t = f"regexp_replace(lower({text}), '[_\\-]+', ' ', 'g')"
    hits = ", ".join(
        f"CASE WHEN regexp_matches({t}, '{_WB}(?:{'|'.join(words)}){_WE}') THEN '{field}' END" for field, words in N.SYNONYMS.items()
    )
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


@register(
    "synonym_join",
    over("requests", f"SELECT _rid, f[1] AS field FROM (SELECT _rid, {_fields_sql('text')} AS f FROM requests) WHERE len(f) = 1"),
)
def synonym_join(spark, folder):
    return N.synonym_join(view(spark, folder, "requests"), "text", ["_rid"])


@register(
    "synonym_join_documents",
    f"SELECT doc_id, f[1] AS field FROM (SELECT doc_id, {_fields_sql('text')} AS f FROM {_SPOKEN_SQL}) WHERE len(f) = 1",
)
def synonym_join_documents(spark, folder):
    return N.synonym_join(_spoken(spark, folder), "text", ["doc_id"])


_SLOT = "CASE WHEN label IN ('GROUP_BY', 'ANOMALY', 'COUNT') THEN 'price' WHEN label = 'FILTER' THEN 'age' END"


@register(
    "score_predictions",
    over(
        "requests",
        f"""WITH p AS (SELECT label, {_sql_label('text')} AS predicted, {_SLOT} AS slot, {_fields_sql('text')} AS fields, latency_ms FROM requests)
            SELECT count(*) AS queries, round_even(avg(CAST(predicted = label AS INT)) * 100, 2) AS accuracy_pct,
            round_even(avg(CAST(slot IS NULL OR list_contains(fields, slot) AS INT)) * 100, 2) AS slot_hit_pct,
            round_even(avg(latency_ms), 2) AS avg_latency_ms, round_even(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms FROM p""",
    ),
)
def score(spark, folder):
    requests = view(spark, folder, "requests").withColumn("slot", F.expr(_SLOT))
    predicted = N.label_by_rules(requests, "text", name="predicted")
    return score_predictions(N.synonym_fields(predicted, "text"), "predicted", "label", "fields", "slot", "latency_ms")
