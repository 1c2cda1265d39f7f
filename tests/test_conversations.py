"""Histories kept message by message against those trimmed in one go."""

from pyspark.sql import functions as F

from tessera import config
from tessera.operators import context
from tessera.streaming import conversations

BUDGET = config.Budget(history=200)


def run(spark, folder, batches, idle_ms=None, again=False):
    """Each batch a file, in order; returns the rows of each conversation."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", conversations.PROVIDER)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in/*")
    out = []
    sink = lambda df, n: out.extend((n, r) for r in df.collect())
    query = conversations.histories(stream, BUDGET, idle_ms).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    told = {}
    for _, r in sorted(out, key=lambda x: x[0]):
        told.setdefault(r.conv_id, []).append(r)
    return told


def wanted(messages):
    rows = context.trim_history(context.turns(messages), BUDGET)
    kept, tokens = {}, {}
    for r in rows.collect():
        kept.setdefault(r.conv_id, []).append(r.turn)
        tokens[r.conv_id] = max(tokens.get(r.conv_id, 0), r.suffix_tokens)
    return {c: (sorted(t), tokens[c]) for c, t in kept.items()}


def test_last_state_equals_the_trimmed_history(spark, sf, tmp_path):
    messages = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(900, 0, "system", "s"), (900, 1, "assistant", "a"), (900, 2, "user", "  "), (900, 3, "user", "q"), (900, 4, "tool", "t"), (900, 5, "assistant", "late"), (901, 0, "user", "x" * 9000), (901, 1, "assistant", "y"), (902, 0, "user", "x" * 9000), (902, 1, "user", None)], "conv_id long, turn long, role string, text string")
    messages = messages.unionByName(extra).cache()
    # halves of conversations come in different batches, some messages twice
    cut = F.coalesce(F.col("turn"), F.lit(0)) + F.col("conv_id") % 2
    batches = [messages.filter(cut <= 1), messages.filter((cut > 0) & (cut <= 4)), messages.filter(cut > 4)]
    got = {c: (r[-1].turns, r[-1].history_tokens) for c, r in run(spark, tmp_path, batches).items()}
    want = wanted(messages)
    assert {c: g for c, g in got.items() if g[0]} == want and all(g == ([], 0) for c, g in got.items() if c not in want)


def test_an_idle_conversation_ends(spark, tmp_path):
    one = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "hi")], "conv_id long, turn long, role string, text string")
    told = run(spark, tmp_path, [one], idle_ms=1)[1]
    assert told[0].turns == [0] and told[0].history.count("\n") == 1 and not told[0].ended
    spark.createDataFrame([(2, 0, "user", "other")], one.schema).coalesce(1).write.parquet(f"{tmp_path}/in/next")
    again = run(spark, tmp_path, [], idle_ms=1)
    assert again[2][0].turns == [0]
    ends = [r for r in told + again.get(1, []) if r.ended]
    assert len(ends) == 1 and ends[0].turns == [] and ends[0].last_turn == 1
