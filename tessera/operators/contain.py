"""Which of many strings stand in which texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Needles of at most so many bytes are searched for in one pass over the texts.
NEEDLE_BYTES = 32 << 20
_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(owner: str, needles: list[str]) -> ahocorasick.Automaton:
    if owner not in _automata:
        _automata.clear()  # a worker holds one at a time
        made = ahocorasick.Automaton()
        for needle in needles:
            made.add_word(needle, needle)
        made.make_automaton()
        _automata[owner] = made
    return _automata[owner]


def containing(rows: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """``rows`` without ``text``, with ``needle``: one row for each distinct, not empty needle that the text holds.

    Each text is read once, whatever the number of needles, by an automaton of all of them; nothing is
    shuffled.  The needles are sent to the scan in parts of at most NEEDLE_BYTES, each a pass.
    """
    spark = rows.sparkSession
    wanted = needles.select(F.col(needle).alias("_n")).filter("length(_n) > 0").distinct()
    size = wanted.agg(F.sum(F.octet_length("_n"))).first()[0] or 0
    passes = max(1, -(-size // NEEDLE_BYTES))
    kept = [f for f in rows.schema if f.name != text]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{needle}` string"])
    found = None
    for part in range(passes):
        sent = spark.sparkContext.broadcast(sorted(r._n for r in wanted.filter(F.pmod(F.xxhash64("_n"), F.lit(passes)) == part).collect()))
        owner = f"{spark.sparkContext.applicationId} {id(sent)}"

        def run(batches, sent=sent, owner=owner):
            if not sent.value:
                return
            machine = _automaton(owner, sent.value)
            for batch in batches:
                at, said = [], []
                for i, t in enumerate(batch.column(text).to_pylist()):
                    for n in {n for _, n in machine.iter(t or "")}:
                        at.append(i)
                        said.append(n)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(take) for f in kept), pa.array(said, pa.string())], [*(f.name for f in kept), needle])

        got = rows.select(*(f.name for f in kept), text).mapInArrow(run, kind)
        found = got if found is None else found.unionByName(got)
    return found
