"""What the corpus operators share: written intermediate tables, word rules, fast word-wise tokenization."""

from __future__ import annotations

import atexit
import ctypes
import functools
import json
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and bytes 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the setting is absent and Spark runs on this machine alone."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tilewright-")


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What holds while an intermediate table is written. Arrow batches of 64 MB, Spark's default, are held several times over
#: by executor and worker; a row larger than this is a batch of its own.
_WRITING = {_SHUFFLE_CLEANUP: "true", _BATCH_BYTES: "8000000b"}


class Scratch:
    """Intermediate tables that go together.

    Tables written within ``with scratch:`` belong to it until ``release()``,
    which is for callers that have written what they made of them; other
    callers' tables stay.
    """

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)

    def release(self) -> None:
        while self.tables:
            _delete(*self.tables.pop())


_rest = Scratch()
_open: list[Scratch] = [_rest]
_every: set[Scratch] = {_rest}


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back.

    This cuts the lineage: an executor lost later costs a re-read, not a
    recomputation, and the shuffle files of the writing job are freed at its
    end. The written files go by ``discard``, with their ``Scratch`` or when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    owner = _open[-1]
    _every.add(owner)
    owner.tables.append((spark, path))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables at once, for the operator that wrote them and reads them no more."""
    for t in tables:
        for owner in list(_every):
            for entry in [e for e in owner.tables if e[1] == t._scratch_path]:
                owner.tables.remove(entry)
                _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for owner in list(_every):
        try:
            owner.release()
        except Exception:  # the session may be gone already
            return


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column, by one scan of that column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")).first()[0]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# White_Space of Unicode, which the byte-level pre-tokenizer splits by.
_WS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Cuts only where every byte-level pre-tokenization cuts as well: before white
# space that follows other text. A lone space stays with the next word, a lone
# line feed is a segment, any other run of white space stays with what follows.
_SEGMENT = re.compile(f" ?[^{_WS}]+|\\n(?=[^{_WS}])|[{_WS}]+[^{_WS}]*")


# RE2: texts that are not plain, where the pattern cuts. Plain text has neither NULs nor other white space than single
# spaces and line feeds between words, and its full stops and commas follow letters or digits.
_ODD = r"\A[ \n]|[ \n]\z|[ \n]{2}|(?:\A|[^\pL\pN])[.,]|[\x00\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words that go to the library as one text.
_AT_ONCE = 100


class WordTokenizer:
    """Byte-level BPE ids of texts, each distinct segment encoded once.

    ``encode(texts)`` gives one little-endian unsigned 32-bit ``bytes`` value
    for each text of a list or an Arrow column. Ids are those of the tokenizers
    library on the whole text; texts that hold an added token, such as
    ``<|endoftext|>``, go to it whole. Segments are cut, numbered and put
    together again by Arrow; Python sees each once a call. The cache of
    segments is dropped when it would pass ``max_words``.

    A segment stands for a space and itself, but for those that begin with a
    line feed, a full stop or a comma, which stand for themselves, as do those
    marked by a leading NUL.
    """

    def __init__(self, path: str, max_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        self.max_words = max_words
        self.sizes = self._token_sizes()
        self.letters = self._for_letters()

    def forget(self) -> None:
        self.ids.clear()

    def _token_sizes(self) -> np.ndarray:
        """Bytes of each token."""
        out = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = len(piece)  # the vocabulary writes each byte as one character
        return out

    def _for_letters(self):
        """The same model for words of ASCII letters, which a byte-level pre-tokenizer never splits: cut at spaces alone, the
        space of a word written as that pre-tokenizer writes it. None where another one stands before the model."""
        from tokenizers import Tokenizer

        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or kind["truncation"] or kind["padding"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            return None
        out = Tokenizer.from_str(json.dumps(kind | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
        # Every word comes once, so the library's own cache of words is of no use.
        resize = getattr(out.model, "_resize_cache", None)
        if resize:
            resize(0)
        return out

    def _learn(self, words: list[str]) -> None:
        """Encodes new segments. Those that begin with white space are joined, since the
        pre-tokenization cuts between them, and their ids are told apart by bytes."""
        alone = [s for s in words if s[0] in "\0.,"]
        for i in range(0, len(alone), 5000):
            part = alone[i : i + 5000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([s.removeprefix("\0") for s in part], add_special_tokens=False), strict=True):
                self.ids[word] = array("I", e.ids).tobytes()
        joined = [s for s in words if s[0] not in "\0.,"]
        letters: list[str] = []
        if self.letters is not None:
            signs: list[str] = []
            for s in joined:
                (letters if s.isalpha() and s.isascii() else signs).append(s)
            joined = signs
        self._learn_joined(self.letters, letters, " \u0120")
        self._learn_joined(self.tokenizer, joined, " ")

    def _learn_joined(self, tokenizer, words: list[str], space: str) -> None:
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            plain = [s if s[0] == "\n" else space + s for s in part]
            found = tokenizer.encode_batch_fast(["".join(plain[j : j + _AT_ONCE]) for j in range(0, len(plain), _AT_ONCE)], add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in found])
            at, ends = np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) + (s[0] != "\n") for s in part])
            cut = np.searchsorted(at, ends)
            if not (at[cut] == ends).all():
                raise ValueError("a token crosses two words")
            raw, cuts = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
            self.ids.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def _ids_of(self, words: list[str]) -> list[bytes]:
        found = list(map(self.ids.get, words))
        lacking = [i for i, own in enumerate(found) if own is None]
        if len(self.ids) + len(lacking) > self.max_words:
            self.ids.clear()
            lacking = range(len(words))
        self._learn([words[i] for i in lacking])
        for i in lacking:
            found[i] = self.ids[words[i]]
        return found

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        column = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        odd, whole = pc.match_substring_regex(column, _ODD), np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        empty = pc.binary_length(column).to_numpy() == 0
        odd = odd.to_numpy(zero_copy_only=False) & ~whole & ~empty
        out = [b""] * len(column)
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.asarray(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        plain = np.flatnonzero(~(odd | whole | empty))
        # In plain text a stop or comma begins a run of signs, so the pre-tokenization cuts before it.
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), column.take(pa.array(plain, pa.int64())), pa.scalar("", pa.large_string()))
        for sign in ".,\n":
            marked = pc.replace_substring(marked, sign, " " + sign)
        lists = pc.split_pattern(marked, " ")
        odd = np.flatnonzero(odd)
        by_pattern = [["\0" + s for s in _SEGMENT.findall(t)] for t in column.take(pa.array(odd, pa.int64())).to_pylist()]
        counts = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray([len(s) for s in by_pattern], np.int64)])
        segments = pa.concat_arrays([lists.flatten(), pa.array([s for own in by_pattern for s in own], pa.large_string())]).dictionary_encode()
        if not len(segments):
            return out
        ids = pa.array(self._ids_of(segments.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(segments.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1][np.cumsum([0, *counts])].tolist()
        body = memoryview(ids.buffers()[2] or b"")
        for i, a, b in zip(np.concatenate([plain, odd]).tolist(), ends, ends[1:], strict=False):
            out[i] = bytes(body[a:b])
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its words outlive a task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def forget_words() -> None:
    """Frees the words that this worker knows from an earlier task; for tasks that do something else."""
    for t in _tokenizers.values():
        t.forget()


def give_back() -> None:
    """Returns memory that this worker has freed to the machine: a worker that waits for its next task counts as its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that needs no words: it forgets those of earlier tasks first, and gives back what it freed."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch, most_bytes: int = 4_000_000, column: str | int = "text"):
    """Parts of an Arrow batch with about ``most_bytes`` of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
