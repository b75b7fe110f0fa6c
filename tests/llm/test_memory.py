"""What tasks of the corpus operators leave in their workers, and how much they are handed at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, near_dedup, suffix_dedup
from tilewright.llm.common import default_tokenizer, discard, materialize, word_tokenizer


class Table:
    """Gives the function that an operator would run in its tasks."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def select(self, *columns):
        return self

    def where(self, condition):
        return self

    def join(self, *others):
        return self

    def hint(self, name):
        return self


@pytest.mark.parametrize("operator", [lambda t: near_dedup.sketches(t, 3), suffix_dedup.pack_runs, lambda t: decontaminate.benchmark_items(t, "doc_id", "text")])
def test_tasks_without_words_forget_those_of_earlier_tasks(spark, operator):
    words = word_tokenizer(default_tokenizer())
    words.encode(["some words of an earlier task"])
    assert words.ids
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d", "e f g h"])], names=["doc_id", "text"])
    assert list(operator(Table()).run(iter([batch])))
    assert not words.ids


def test_comparisons_of_near_copies_forget_words_too(spark):
    words, batch = word_tokenizer(default_tokenizer()), pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d", "e f g h"])], names=["doc_id", "text"])
    words.encode(["some words of an earlier task"])
    sets = pa.concat_arrays([b.column(1) for b in near_dedup.full_sets(Table(), Table(), 3).run(iter([batch]))])
    assert not words.ids
    words.encode(["some words of an earlier task"])
    pairs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), sets[:1], sets[1:]], names=["a", "b", "sa", "sb"])
    assert [b.column(3).to_pylist() for b in near_dedup.confirm(Table(), Table(), 85).run(iter([pairs]))] == [[4]]
    assert not words.ids


def test_written_tables_are_handed_over_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") == 1500, F.repeat(F.lit("y"), 12_000_000)).otherwise(F.repeat(F.lit("x"), 10_000)).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    table = materialize(rows.mapInArrow(sizes, "rows long, bytes long"), "sizes")
    found = [tuple(r) for r in table.collect()]
    discard(table)
    assert sum(n for n, _ in found) == 3000
    assert max(size for _, size in found) < 8_100_000 + 12_000_000
    assert sorted(size for _, size in found)[-2] < 8_100_000
    assert spark.conf.get(name) == before
