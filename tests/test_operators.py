"""Small worked examples, and rules where a naive version goes wrong."""

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import aggregates, cleaning, columns, diff, encode, filters, impute, insights, joins, ordering
from quillgrid.operators import profile, rows, text
from quillgrid.operators.filters import Condition
from quillgrid.plans.steps import run_steps
from quillgrid.session import scratch_path
from quillgrid.sources import ingest
from quillgrid.sources.sqlbox import sql
from quillgrid.sources.versions import VersionedTable


def values(df, column):
    return [r[column] for r in df.collect()]


# worked examples


def test_typos_are_repaired(people):
    got = set(values(cleaning.clean_table(people, ["Department"]), "Department"))
    assert got == {"Engineering", "Marketing", "Sales"}


def test_sql_after_cleaning(spark, people):
    cleaned = cleaning.clean_table(people, ["Department"])
    query = "SELECT Department, avg(Salary) AS avg_sal FROM {dataset} GROUP BY Department ORDER BY avg_sal DESC"
    got = sql(spark, query, dataset=cleaned)
    assert got.columns == ["Department", "avg_sal"] and got.count() == 3


def test_commit_diff_and_rollback(spark, people):
    versions = VersionedTable(spark, scratch_path(spark, "test-versions"))
    first = versions.commit(people, "load", "INGEST")
    edited = columns.update_where(first, "Salary", 90000, Condition("_rid", "==", 0))
    assert diff.table_diff(first, edited).first()["modified_cells"] == 1
    versions.commit(edited, "raise", "UPDATE_VALUE")
    assert versions.history().count() == 2
    assert versions.current().where("_rid = 0").first()["Salary"] == 90000
    assert versions.rollback(0).where("_rid = 0").first()["Salary"] == 75000
    assert versions.rollback(5).where("_rid = 0").first()["Salary"] == 75000
    # a commit after going back drops what lay ahead; numbers never repeat
    versions.commit(people, "again", "DROP_NULLS")
    assert values(versions.history(), "version") == [1, 3]
    assert values(versions.history(), "tag") == ["v1_initial", "v3_drop_nulls"]


def test_steps_are_split(spark):
    request = "In age column where age > 40 replace it with 20 and then sort by salary descending"
    others = ["one, and after that two;;three.", "then", "  also the last and then"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([request, *others])], "id int, text string")
    got = {(r["id"], r["step"]): r["query"] for r in text.split_steps(df, "text", ["id"]).collect()}
    assert got == {
        (0, 1): "In age column where age > 40 replace it with 20",
        (0, 2): "sort by salary descending",
        (1, 1): "one",
        (1, 2): "two",
        (1, 3): "three",
        (2, 1): "then",
        (3, 1): "the last",
    }


def test_person_is_found_by_name(people):
    got = filters.filter_all(people, [Condition("Name", "==", "john")])
    assert values(got, "Name") == ["John Doe"]  # not Bob Johnson: whole words first
    part = filters.filter_all(people, [Condition("Name", "==", "johns")])
    assert values(part, "Name") == ["Bob Johnson"]
    assert values(filters.filter_by_value(people, "need the data of john", ["Name"]), "Name") == ["John Doe"]


def test_filter_by_value_conflict_and_negation(people):
    with pytest.raises(ValueError):
        filters.filter_by_value(people, "show sales and marketing", ["Department"])
    with pytest.raises(ValueError):
        filters.filter_by_value(people, "show nothing known", ["Department"])
    kept = filters.filter_by_value(people, "everyone except Sales", ["Department"])
    assert "Sales" not in values(kept, "Department") and kept.count() == 4


@pytest.mark.parametrize(
    "request_text, kind",
    [
        ("Can you calculate the total sum of sales?", "SUM"),
        ("Give me a breakdown of average earnings for each team", "GROUP_BY"),
        ("Display all employees with missing age", "SHOW_NULLS"),
        ("Find statistical anomalies in price", "ANOMALY"),
        ("NEED THE DATA OF JOHN NAME", "FILTER"),
        ("IN AGE COLUMN WHERE AGE IS ABOVE 40 REPLACE IT WITH 20", "UPDATE_VALUE"),
        ("calculate median salary", "MEDIAN"),
        ("find mode of department", "MODE"),
        ("add column Bonus with value 5000", "ADD_COL"),
        ("add row with name Alex salary 60000", "ADD_ROW"),
        ("", "SUMMARY"),
        ("sort by age", "SORT"),
        ("top 5 salaries", "TOP_N"),
        ("show correlation matrix", "FILTER"),
        ("correlation matrix", "CORRELATION"),
        ("minimum then maximum", "MIN"),
    ],
)
def test_request_kinds(spark, request_text, kind):
    df = spark.createDataFrame([(request_text,)], "text string")
    assert text.label_by_rules(df, "text").first()["label"] == kind


def test_number_words(spark):
    df = spark.createDataFrame(
        [
            (0, "where age is above forty replace it with twenty"),
            (1, "twenty five, seventy thousand and five hundred"),
            (2, "40 is forty; point five"),
            (3, "no numbers, only thousands"),
        ],
        "id int, text string",
    )
    got = {}
    for r in text.extract_word_numbers(df, "text", ["id"]).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["number"])
    # "five seventy" and "thousand and" are neighbours too
    assert got == {0: [40, 20], 1: [20, 25, 5, 75, 70, 70000, 1000, 500, 100], 2: [0.5, 5]}


def test_comparisons(spark):
    cases = [
        ("age over forty and pay under 80k", [(">", 40.0), ("<", 80000.0)]),
        ("at least two hundred five, at most $1,250.50", [(">=", 205.0), ("<=", 1250.5)]),
        ("older than twenty five or above five hundred thousand", [(">", 25.0), (">", 500000.0)]),
        ("price >= 3 million", [(">=", 3e6)]),
        ("above the limit", [(">", None)]),
        ("over five point two", [(">", 5.2)]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    got = {}
    for r in text.extract_comparisons(df, "text", ["id"]).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["operator"], r["number"]))
    assert got == {i: found for i, (_, found) in enumerate(cases)}


def test_synonyms(spark):
    df = spark.createDataFrame([(0, "sum of earnings"), (1, "staff of each team"), (2, "how many years old")], "id int, text string")
    got = {r["id"]: r["field"] for r in text.synonym_join(df, "text", ["id"]).collect()}
    assert got == {0: "salary", 2: "age"}  # the second points to two fields


def test_conditional_update(people):
    updated = columns.update_where(people, "Age", 20, Condition("Age", ">", 40))
    assert updated.where("Age > 40").count() == 0 and updated.where("Age = 20").count() == 2


def test_median_mode_and_adding(people):
    assert aggregates.aggregate(people, "median", "Salary").first()["value"] == 75000
    assert aggregates.mode_of_text(people, "Department").first()["value"] == "Engineering"  # all tied: smallest
    assert "Bonus" in columns.add_constant(people, "Bonus", "5000").columns
    more = rows.append_row(people, {"Name": "Alex", "Salary": "$60,000"})
    assert more.count() == 6 and more.where("Name = 'Alex'").first()["Salary"] == 60000
    with pytest.raises(ValueError):
        rows.append_row(people, {"Salary": "a lot"})


def test_encoding(people):
    onehot = encode.encode(people, "onehot", ["Department"])
    assert "Department_Marketing" in onehot.columns and "Department_Enginering" in onehot.columns
    assert "Department_Engineering" not in onehot.columns  # the first value is left out
    with pytest.raises(ValueError):
        encode.encode_onehot(people, ["Name"], max_values=3)


def test_mice_leaves_no_gap(people):
    assert impute.impute(people, "mice").where("Age IS NULL").count() == 0


def test_insights_name_every_kind(people):
    found = insights.insight_table(people).orderBy("rank").collect()
    assert {"overview", "missing", "category", "distribution", "outliers", "correlation"} >= {r["kind"] for r in found}
    assert found[0]["kind"] == "overview" and all(r["text"] for r in found)


# rules


def test_not_equal_keeps_nulls(people):
    assert filters.filter_all(people, [Condition("Age", "!=", 29)]).count() == 4
    assert columns.updated_rows(people, Condition("Age", "!=", 29)).first()[0] == 4


def test_sum_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1.0)], "k string, v double")
    pandas_like = {r["k"]: r["sum_v"] for r in aggregates.group_agg(df, "k", "sum", "v").collect()}
    sql_like = {r["k"]: r["sum_v"] for r in aggregates.fast_group_agg(df, "k", "v", "sum").collect()}
    assert pandas_like == {"a": 0.0, None: 1.0} and sql_like == {"a": None, None: 1.0}
    assert aggregates.fast_group_agg(df, "k", "v", "stddev").columns == ["k", "avg_v"]
    empty = df.where("false")
    assert aggregates.aggregate(empty, "sum", "v").first()[0] == 0
    assert aggregates.aggregate(empty, "median", "v").first()[0] is None


def test_skewness_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (10.0, 5.0, 1.0)], "a double, flat double, few double")
    got = {r["column"]: r["skewness"] for r in profile.skewness(df).collect()}
    assert got["flat"] == 0.0 and got["few"] is None and abs(got["a"] - 1.65) < 0.01


def test_half_even_rounding(spark):
    df = spark.createDataFrame([("x", 0.125), ("y", 2.675)], "k string, v double")
    got = {r["k"]: r["m"] for r in columns.add_group_stat(df, "m", "k", "v", "mean").collect()}
    assert got == {"x": 0.12, "y": 2.68}


def test_numbers_in_text(spark):
    texts = ["1e5", " 7 ", "$1,234", "1d", "12%", "(5)", "1_000", "inf", "NaN", "", None, ".5", "5."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(ingest.parse_number(F.col("t"))).collect()]
    assert got == [1e5, 7.0, 1234.0] + [None] * 8 + [0.5, 5.0]


def test_numeric_share_is_inclusive(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "x"), ("$3", "y"), ("4", "4"), ("x", "5"), (None, " ")], "a string, b string")
    assert ingest.number_like_columns(df) == ["a"]  # 4 of 5 filled cells


def test_division_by_zero_and_taken_name(people):
    out = columns.add_formula(people, "ratio", "Salary", "/", 0)
    assert set(values(out, "ratio")) == {None}
    with pytest.raises(ValueError):
        columns.add_formula(people, "Age", "Salary", "+", 1)
    same = columns.verify_derived_column(out.withColumn("twice", F.col("Salary") * 2), "twice", F.col("Salary") * 2.0)
    assert same.count() == 5
    with pytest.raises(ValueError):
        columns.verify_derived_column(people, "Age", F.col("Salary"))


def test_replacement_changes_type_only_when_needed(people):
    assert columns.replace_value(people, "Salary", "75000", "1").schema["Salary"].dataType.simpleString() == "bigint"
    texted = columns.replace_value(people, "Salary", "75000", "unknown")
    assert texted.schema["Salary"].dataType.simpleString() == "string"
    assert values(texted.where("_rid = 0"), "Salary") == ["unknown"]
    assert columns.replace_value(people, "Department", " SALES ", "Sells").where("Department = 'Sells'").count() == 1


def test_substring_filter_is_literal(spark):
    df = spark.createDataFrame([("a.b",), ("axb",)], "t string")
    assert values(filters.filter_all(df, [Condition("t", "==", "a.")]), "t") == ["a.b"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert aggregates.aggregate(ingest.nan_to_null(df), "max", "v").first()[0] == 1.0


def test_csv_missing_tokens_and_types(spark):
    raw = spark.createDataFrame(
        [("1", "2.5", "True", "x ", "NA"), ("n/a", "", "False", "<NA>", "null"), ("3", "-nan", "true", " y", "")],
        "i string, d string, b string, t string, none string",
    )
    path = ingest.csv_sink(raw, scratch_path(spark, "test-csv"))
    got = ingest.csv_scan(spark, path)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "double", "boolean", "string", "double"]
    rows_ = {tuple(r) for r in got.collect()}
    assert rows_ == {(1, 2.5, True, "x ", None), (None, None, False, None, None), (3, None, True, " y", None)}


def test_csv_line_breaks_and_quotes(spark):
    df = spark.createDataFrame([("a \"quoted\", cell", 1), ("two\nlines", 2)], "t string, n long")
    path = ingest.csv_sink(df, scratch_path(spark, "test-csv"))
    got = ingest.csv_scan(spark, path, multi_line=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_sorting_puts_nulls_last(people):
    assert values(ordering.sort_by(people, "Age"), "Age")[-1] is None
    down = values(ordering.sort_by(people, "Age", descending=True), "Age")
    assert down[0] == 51.0 and down[-1] is None
    assert values(ordering.top_n(people, "Department", 2), "_rid") == [0, 1]  # text: first rows


def test_diff_of_removed_row(people):
    found = diff.table_diff(people, people.where("_rid <> 1").drop("Age")).first()
    assert (found["rows_removed"], found["rows_added"], found["modified_cells"]) == (1, 0, 0)
    assert (found["columns_removed"], found["total_columns_after"]) == (1, 4)


def test_join_kinds_and_names(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s")], "id int, v string")
    sizes = {h: joins.join_tables(a, b, "k", "id", h).count() for h in ("inner", "left", "right", "full", "odd")}
    assert sizes == {"inner": 2, "left": 4, "right": 4, "full": 6, "odd": 2}
    full = joins.join_tables(a, b, "k", "id", "full")
    assert full.columns == ["k", "v", "v_b"]
    assert full.where("k IS NULL").count() == 3  # right-only rows have no key


def test_failing_step_keeps_input(people):
    outcome = run_steps(people, [lambda t: t.drop("Age"), lambda t: t.select("no such column")])
    assert outcome.failed_step == 2 and outcome.table is people and outcome.message


def test_single_letter_words_and_lookup(spark):
    entries = spark.createDataFrame([("Sleep_Duration_Hours",), ("Sleep_Quality",), ("Age",)], "e string")
    asked = spark.createDataFrame([("hours sleep duration",), ("sleep duration hour",), ("sleep",)], "q string")
    got = {r["value"]: r["match"] for r in text.fuzzy_lookup(asked, "q", entries, "e").collect()}
    assert got == {"hours sleep duration": "Sleep_Duration_Hours", "sleep duration hour": "Sleep_Duration_Hours"}
    how = {(r["value"], r["match"]): r["how"] for r in text.fuzzy_candidates(asked, "q", entries, "e").collect()}
    assert how[("sleep", "Sleep_Quality")] == "part"


def test_category_candidates_skip_ids(spark):
    df = spark.createDataFrame([(i, f"u{i}", "a" if i % 2 else "b", "same") for i in range(40)], "n int, user_id string, kind string, flat string")
    assert values(insights.category_candidates(df), "column") == ["kind"]
    assert values(insights.category_candidates(df, approx=True), "column") == ["kind"]


def test_awkward_column_names(spark):
    """Dots, spaces, and names the operators use themselves."""
    rows_ = [(i, "ab"[i % 2], float(i * i), i % 3, "x" if i else None) for i in range(12)]
    df = spark.createDataFrame(rows_, "_rid long, column string, `unit.price` double, n int, `my text.` string")
    for func in aggregates.FUNCTIONS:
        assert aggregates.group_agg(df, "column", func, "unit.price").count() == 2
        assert aggregates.group_agg(df, "n", func, "unit.price").count() == 3
        assert columns.add_group_stat(df, "stat", "my text.", "unit.price", func).count() == 12
        assert aggregates.aggregate(df, func, "unit.price").count() == 1
    median = {r["column"]: r["median_unit.price"] for r in aggregates.group_agg(df, "column", "median", "unit.price").collect()}
    assert median == {"a": 26.0, "b": 37.0}
    assert aggregates.group_agg_all(df, "column", "median").columns == ["column", "unit.price", "n"]
    assert aggregates.aggregate_matrix(df, ["mean", "median", "mode"]).count() == 2
    assert aggregates.describe(df).count() == 4
    assert aggregates.correlations(df).count() == 4
    assert aggregates.fast_group_agg(df, "my text.", "unit.price").count() == 2
    assert profile.table_profile(df).count() == 4
    assert insights.insight_table(df).count() >= 4
    assert filters.filter_all(df, [Condition("unit.price", ">", 50), Condition("my text.", "==", "x")]).count() == 4
    assert filters.rows_with_null(df).count() == 1 and filters.drop_null_rows(df).count() == 11
    assert columns.update_where(df, "unit.price", None, Condition("n", "==", 1)).count() == 12
    assert columns.drop_column(df, "unit.price").columns == ["_rid", "column", "n", "my text."]
    assert columns.rename_column(df, "unit.price", "price").columns[2] == "price"
    assert ordering.top_n(df, "unit.price", 2).first()["_rid"] == 11
    assert ordering.with_position(df, [F.col("`unit.price`").desc()]).count() == 12
    assert cleaning.clean_table(df, ["my text.", "column"]).count() == 12
    assert encode.encode(df, "onehot", ["my text."]).count() == 12
    assert encode.encode(df, "label", ["my text.", "column"]).count() == 12
    gaps = df.withColumn("unit.price", F.when(F.col("_rid") != 5, F.col("`unit.price`")))
    for method in ("knn", "mice", "median"):
        filled = impute.impute(gaps, method)
        assert filled.columns == df.columns and filled.where("`unit.price` IS NULL OR `my text.` IS NULL").count() == 0
    assert diff.cell_changes(df, gaps).count() == 1
    assert diff.table_diff(df, gaps).first()["modified_cells"] == 1
    assert rows.append_row(df, {"unit.price": "7"}).count() == 13
    joined = joins.join_tables(df, df, "unit.price", "unit.price", "full")
    assert joined.count() == 12 and "n_b" in joined.columns
    assert ingest.value_dictionary(df).count() == 3
