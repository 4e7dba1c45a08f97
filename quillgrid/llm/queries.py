"""The queries of this subpackage and, where SQL can tell the answer, their checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import balltree, bpe, chat, digest, jaccard, manifest, mixing, passages, perplexity, repeats, secrets, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_ngram_perplexity")
def ngram_perplexity(spark, folder):
    """The base rules and the perplexity band of every document."""
    return perplexity.quality_rules(_table(spark, folder, "documents"))


def _spans_sql(rule: secrets.Rule) -> str:
    """DuckDB: the list of (start, end, kind) of one rule's matches."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    value = f"regexp_extract_all(t, {pattern}, {rule.group})"
    return f"""(SELECT coalesce(list({{'a': s.a, 'b': s.a + s.n, 'k': '{rule.kind}'}}), []) FROM (
        SELECT length(m[i]) AS n, length(v[i]) AS vn,
               coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS a
        FROM (SELECT regexp_extract_all(t, {pattern}) AS m, {value} AS v, string_split_regex(t, {pattern}) AS p) q,
             LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) r) s WHERE s.vn >= {rule.least})"""


_RANK = "CASE s.k " + " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate(secrets.RULES)) + " END"
_SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, doc_id, list_concat({", ".join(_spans_sql(r) for r in secrets.RULES)}) AS l FROM d),
s AS (SELECT r, unnest(l) AS s FROM f),
g AS (SELECT r,
        count(*) FILTER (s.k = 'assign') AS n_assign, count(*) FILTER (s.k = 'access') AS n_access,
        count(*) FILTER (s.k = 'hex') AS n_hex,
        string_agg(s.k || ':' || s.a || ':' || s.b, ',' ORDER BY s.a, {_RANK}) FILTER (s.k IN ('assign', 'access', 'hex')) AS base,
        string_agg(s.k || ':' || s.a || ':' || s.b, ',' ORDER BY s.a, {_RANK}) AS spans
      FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM f LEFT JOIN g USING (r)"""


@_query("op2_secret_scan", _SECRETS_SQL)
def secret_scan(spark, folder):
    """Spans of secrets in every document, base kinds and published formats."""
    found = secrets.scan_secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in kinds],
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(F.col("secret_spans")).alias("spans"),
    )


_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN m USING (d)"""


@_query("op3_warc_dictionary", _WARC_SQL)
def warc_dictionary(spark, folder):
    """Pages written to archives and read back."""
    manifest, place = warc.archive_pages(_table(spark, folder, "pages"))
    return warc.read_archives(manifest, place).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS body,
        replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@_query("op4_chat_events", _CHAT_SQL)
def chat_events(spark, folder):
    """Every conversation, folded from a log, rendered and read back."""
    hard = r"\### Assistant: </turn> ok"
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    back = chat.read_back(chat.format_chats(chat.events_of(rows.unionByName(own))))
    learned = F.array_join(F.transform(F.filter("messages", lambda m: m["loss"]), lambda m: m["text"]), "")
    every = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


_MIX_SQL = """
WITH s AS (SELECT source, coalesce(sum(length(text)), 0) AS size FROM documents GROUP BY source),
w AS (SELECT source, CAST(size AS DOUBLE) AS size, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), 0.7) ELSE 0 END AS weight FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) / size ELSE 1.0 END AS rate FROM w),
p AS (SELECT source, j, exp(-rate + j * ln(rate) - lgamma(j + 1.0)) AS p
      FROM r, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT) + 1)) AS j) x),
f AS (SELECT source, list(c ORDER BY j) AS cdf FROM
      (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM p) GROUP BY source),
d AS (SELECT t.*, CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u, cdf
      FROM documents t JOIN f ON t.source IS NOT DISTINCT FROM f.source),
k AS (SELECT *, len(list_filter(cdf, lambda c: c <= u)) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS mix_copy,
       md5('mix-order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || i) AS mix_key
FROM k, LATERAL (SELECT unnest(range(1, n + 1)) AS i) x"""


@_query("op10_poisson_mix", _MIX_SQL)
def poisson_mix(spark, folder):
    """Documents repeated so that a source's share follows its size to the power 0.7."""
    return mixing.mix_sources(_table(spark, folder, "documents"), exponent=0.7)


@_query("op9_byte_bpe")
def byte_bpe(spark, folder):
    """Every document encoded and decoded."""
    words = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(_table(spark, folder, "documents").select("doc_id", "text"), words).drop("text")


@_query("op5_improbable_features")
def improbable_features(spark, folder):
    """Digests of all documents and of their edited texts, compared."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return digest.compare_edits(docs, digest.rarity_ranks(docs))


@_query("op6_jaccard_groups")
def jaccard_groups(spark, folder):
    """Documents grouped by links at 90 of 100 over 3-word shingles."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs, words=3, similarity=(90, 100))


@_query("op7_deobfuscated_toxicity")
def deobfuscated_toxicity(spark, folder):
    """Toxicity of every document."""
    return toxicity.score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op8_passage_attention")
def passage_attention(spark, folder):
    """Quality of every document."""
    return passages.score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def _merkle_sql(levels: int = 7) -> str:
    """DuckDB: the tree level by level, for groups of up to 16 ** levels rows and as many groups."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(text, '{upper}', '{upper.lower()}')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars"))) + " || " + field(text) + ")"
    # unsigned crc32 of the decimal id, bit by bit
    crc = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
    parts = [
        f"""l AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS bad FROM documents)""",
        """a0 AS (SELECT doc_id, source, leaf, bad, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS p,
            count(*) OVER (PARTITION BY source) AS n FROM l)""",
        "n0 AS (SELECT source, p, h, n FROM a0)",
        """f0 AS (SELECT doc_id, source, leaf, p AS q, '' AS proof, bad AS folded FROM a0)""",
    ]
    for kind, group, same in (("", "source, ", "f.source IS NOT DISTINCT FROM r.source AND "), ("g", "", "")):
        for k in range(levels):
            part = "PARTITION BY source" if group else ""
            rest = "string_agg(h, '' ORDER BY p)"
            parts += [
                # the runs of a level; a single node stays as it is
                f"{kind}r{k} AS (SELECT {group}p // 16 AS s, list(h ORDER BY p) AS run, any_value(n) AS n FROM {kind}n{k} GROUP BY {group}p // 16)",
                f"""{kind}n{k + 1} AS (SELECT {group}s AS p, CASE WHEN n > 1 THEN sha256(list_aggregate(run, 'string_agg', '')) ELSE run[1] END AS h,
                    CAST(ceil(n / 16.0) AS BIGINT) AS n FROM {kind}r{k})""",
                f"""{kind}f{k + 1} AS (SELECT f.* EXCLUDE (q, proof, folded), q // 16 AS q,
                    CASE WHEN n > 1 THEN proof || coalesce(list_aggregate(run[1:q % 16], 'string_agg', ''), '') || coalesce(list_aggregate(run[q % 16 + 2:], 'string_agg', ''), '') ELSE proof END AS proof,
                    CASE WHEN n > 1 THEN sha256(coalesce(list_aggregate(run[1:q % 16], 'string_agg', ''), '') || folded || coalesce(list_aggregate(run[q % 16 + 2:], 'string_agg', ''), '')) ELSE folded END AS folded
                    FROM {kind}f{k} f JOIN {kind}r{k} r ON {same}f.q // 16 = r.s)""",
            ]
        if group:
            parts += [
                f"""s AS (SELECT source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM n{levels})""",
                "gn0 AS (SELECT p, h, n FROM s)",
                f"gf0 AS (SELECT f.* EXCLUDE (q), s.p AS q, s.h AS subroot FROM f{levels} f JOIN s ON f.source IS NOT DISTINCT FROM s.source)",
            ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, gn{levels}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = gn{levels}.h AS verified
FROM gf{levels}, gn{levels}"""


@_query("op13_merkle_manifest", _merkle_sql())
def merkle_manifest(spark, folder):
    """Every document as a leaf, proven against the root, some with changed texts."""
    return manifest.document_manifest(_table(spark, folder, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
b AS (SELECT q, item_id, term, count(*) AS n FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
f AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS size, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, c GROUP BY term, n_docs),
s AS (SELECT q, item_id, r, doc_id,
        CAST(sum(n * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * n_docs) // length)))) AS BIGINT) AS score
      FROM f JOIN w USING (term) JOIN b USING (term), c GROUP BY q, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10"""


@_query("op12_ball_tree_search", _SEARCH_SQL)
def ball_tree_search(spark, folder):
    """The ten best documents for every benchmark item."""
    return balltree.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op11_recompression_dedup")
def recompression_dedup(spark, folder):
    """Every document without the passages of 20 words that occur earlier."""
    return repeats.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
