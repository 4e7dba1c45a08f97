"""Row-local operators on a streaming DataFrame."""

from quillgrid.operators import columns, filters, text
from quillgrid.operators.filters import Condition
from registry.base import view

FOLDER = "/root/testdata/sf0.001"


def _rows(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_row_local_operators_accept_streams(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{FOLDER}/events*.parquet")

    def edited(df):
        out = filters.filter_all(df, [Condition("value", ">", 20), Condition("event_type", "!=", "error")])
        out = columns.update_where(out, "value", 0, Condition("user_id", "<", 10))
        out = columns.replace_value(out, "event_type", "VIEW", "seen")
        out = columns.add_formula(out, "half", "value", "/", 2)
        return text.label_by_rules(out, "event_type").select("event_id", "event_type", "value", "half", "label")

    assert _rows(spark, edited(stream), "edited") == sorted(tuple(r) for r in edited(events).collect())


def test_text_operators_accept_streams(spark):
    conversations = view(spark, FOLDER, "conversations")
    stream = spark.readStream.schema(conversations.schema).parquet(f"{FOLDER}/conversations*.parquet")
    keep = ["conv_id", "turn"]
    batch = text.split_steps(conversations, "text", keep)
    assert _rows(spark, text.split_steps(stream, "text", keep), "steps") == sorted(tuple(r) for r in batch.collect())
