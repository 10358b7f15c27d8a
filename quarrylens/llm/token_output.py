"""Token-ID output: Arrow stream files of equal-length sequences and masks.

A folder of shards.  Shard k is two Arrow IPC stream files:

``shard-k.ids.arrows``
    record batches with the fixed-size-list columns ``input_ids`` (uint16 or uint32) and
    ``mask`` (bool, false on padding).  All documents of the shard follow one another; only
    the last sequence is padded.  Every batch but the last holds the same number of
    sequences, and its columns have no nulls and no compression, so every batch takes the
    same number of bytes: batch i begins at ``first + i * stride`` and any sequence can be
    mapped without reading or copying the rest (``SequenceFile``).
``shard-k.docs.arrows``
    one row per document: doc_id, start (ids of the shard before it), n_tokens.

Shards are ranges of ascending doc_id.  A task writes under a name of its own and renames,
so a lost or repeated task leaves one whole shard.

Defined cases: null text is an empty text; an empty text is the end id alone; a null doc_id
sorts first; rows that repeat a doc_id are all written, ordered by their text, and rows equal in
both are equal in the files; a very long text is encoded in parts and lies in as many batches as
it needs; an empty table gives no documents; columns beside the id and the text are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import scratch_path

END_ID = 2
SEQ_LEN = 2048
BATCH_SEQUENCES = 256
TOKENIZER_BYTES_MOST = 64 << 20

_GAP = re.compile(r" (?=\S)")
#: Every character that either library may take for white space.
_SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_ANY_SPACE = re.compile("[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ODD_SPACE = f"[{_SPACES}]{{3}}|[{_SPACES}]{{2}}$"
#: A chunk that ends in ASCII punctuation after a letter or number; both are pieces of their own.
_TAIL = r"(?s)^(?P<core>.*[\pL\pN])(?P<tail>[!-&(-/:-@\[-`{-~]+)$"
_ENCODERS: dict[int, ChunkEncoder] = {}


class _Known:
    """Ids of the strings met so far, one string's after another's."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.chars = self.end = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.starts = np.zeros(1 << 14, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of new keys."""
        first, last, end = len(self.at), len(self.at) + len(keys), self.end + len(ids)
        if last > len(self.sizes):
            self.sizes, self.starts = (np.resize(x, 2 * last) for x in (self.sizes, self.starts))
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        places = np.arange(first, last)
        self.ids[self.end : end] = ids
        self.sizes[first:last] = sizes
        self.starts[first:last] = self.end + np.cumsum(sizes) - sizes
        self.at.update(zip(keys, places.tolist()))
        self.chars, self.end = self.chars + sum(map(len, keys)), end
        return places


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans of flat, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ChunkEncoder:
    """Byte-level BPE by the tokenizers library, each distinct piece of a text encoded once.

    The pre-tokenizer of byte-level BPE always ends a piece before a white-space character
    that a non-space follows, so encoding is the concatenation of the encodings of the chunks
    cut before such spaces and newlines.  With at most two white-space characters together,
    and one at the end, every space and newline may be cut at: those texts are cut, and their
    chunks numbered, in whole columns.  Other texts are cut one by one before such spaces alone,
    and texts that hold an added token are not cut.  A newline before a chunk and punctuation
    after it are pieces of their own.

    Pieces met before come from two generations of a table, each of about ``most`` entries;
    the others of a part are encoded together, and cut where the token of the space or newline
    between them begins.  A text of any length is encoded in parts of about ``part_chars``.
    """

    def __init__(self, tokenizer_json: str, most: int = 500_000, most_chars: int = 16 << 20, part_chars: int = 2 << 20):
        from tokenizers import Tokenizer

        rules = json.loads(tokenizer_json)
        if not _byte_level(rules):
            raise ValueError("the tokenizer must split as byte-level BPE does, without a normalizer, prefix space or added tokens that hold a space")
        self.added = [t["content"] for t in rules.get("added_tokens") or ()]
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = {lead: np.zeros(max(vocab.values()) + 1, bool) for lead in " \n"}
        for token, i in vocab.items():
            self.leads[" "][i] = token.startswith("Ġ")
            self.leads["\n"][i] = token.startswith("Ċ")
        self.most, self.most_chars, self.part_chars = most, most_chars, part_chars
        self.known, self.old = _Known(), _Known()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], lead: str, most: int = 4096) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of pieces, and how many each has; a space is part of its piece, a newline only stands before it."""
        ids, sizes = [], []
        for at in range(0, len(pieces), most):
            part = pieces[at : at + most]
            raw = self._whole(["".join(part) if lead == " " else "\n" + "\n".join(part)])[0]
            cuts = np.flatnonzero(self.leads[lead][raw])
            if len(cuts) == len(part) and (len(part) > 1 or len(cuts) and not cuts[0]):
                size = np.diff(np.append(cuts, len(raw)))
                ids.append(raw if lead == " " else np.delete(raw, cuts))
                sizes.append(size - (lead != " "))
            elif len(part) <= 8:  # white space inside a piece
                for one in self._whole(part):
                    ids.append(one)
                    sizes.append(np.array([len(one)]))
            else:
                more = self._learn(part, lead, len(part) // 2)
                ids += more[0]
                sizes += more[1]
        return ids, sizes

    def _places(self, keys: list[str]) -> np.ndarray:
        """Where the table has the ids of distinct keys, new ones added."""
        if len(self.known.at) > self.most or self.known.chars > self.most_chars:
            self.old, self.known = self.known, _Known()
        known, old = self.known, self.old
        out = np.array(list(map(known.at.get, keys, itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(out < 0)
        if len(new) and old.at:
            before = np.array([old.at.get(keys[i], -1) for i in new.tolist()], np.int64)
            back, before = new[before >= 0], before[before >= 0]
            out[back] = known.add([keys[i] for i in back.tolist()], _gather(old.ids, old.starts[before], old.sizes[before]), old.sizes[before])
            new = np.flatnonzero(out < 0)
        spaced, plain, single = [], [], []
        for i in new.tolist():
            key = keys[i]
            (single if key in ("", " ") or _ANY_SPACE.search(key, key[0] == " ") else spaced if key[0] == " " else plain).append(i)
        for some, lead in ((spaced, " "), (plain, "\n")):
            if some:
                ids, sizes = self._learn([keys[i] for i in some], lead)
                out[some] = known.add([keys[i] for i in some], np.concatenate(ids), np.concatenate(sizes))
        if single:
            ids = self._whole([keys[i] for i in single])
            out[single] = known.add([keys[i] for i in single], np.concatenate(ids), np.array([len(x) for x in ids]))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one text after another, and how many each has."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        even = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        words, many = even.flatten(), np.diff(even.offsets.to_numpy())
        whole: list[str] = []  # texts that hold an added token
        if pc.any(odd).as_py():
            words, many, whole = self._with_odd(texts, odd, words, many)
        begins = np.concatenate([[0], np.cumsum(many)])
        head = np.zeros(len(words), bool)
        head[begins[:-1]] = True
        coded = words.dictionary_encode()
        number, size = coded.indices.to_numpy(), len(coded.dictionary)
        number = np.where(head, number + size, number)  # a text's first chunk has no space before it
        used = np.flatnonzero(np.bincount(number, minlength=2 * size))
        chunks = coded.dictionary.take(pa.array(used % max(1, size)))
        line = pc.and_(pc.starts_with(chunks, "\n"), pa.array(used < size)).to_numpy(zero_copy_only=False)
        chunks = pc.if_else(pa.array(line), pc.utf8_slice_codeunits(chunks, 1), chunks)
        split = pc.extract_regex(chunks, _TAIL)
        cores = pc.if_else(split.is_valid(), split.field("core"), chunks)
        tails = pc.if_else(split.is_valid(), split.field("tail"), "").dictionary_encode()
        lead = pc.if_else(pa.array((used < size) & ~line), " ", "")
        cores = pc.binary_join_element_wise(lead.cast(chunks.type), cores, pa.scalar("", chunks.type)).dictionary_encode()

        # what each distinct chunk is made of: newline, core, tail
        keys = ["\n", *cores.dictionary.to_pylist(), *tails.dictionary.to_pylist()]
        distinct = list(dict.fromkeys(keys))
        at = {k: i for i, k in enumerate(distinct)} if len(distinct) < len(keys) else None
        places = self._places(distinct)
        if at is not None:
            places = places[np.fromiter(map(at.__getitem__, keys), np.int64, len(keys))]
        known = self.known
        made = np.empty((len(used), 3), np.int64)
        made[:, 0] = places[0]
        made[:, 1] = places[1 + cores.indices.to_numpy()]
        made[:, 2] = places[1 + len(cores.dictionary) + tails.indices.to_numpy()]
        sizes = known.sizes[made]
        sizes[~line, 0] = 0
        flat = _gather(known.ids, known.starts[made].ravel(), sizes.ravel())
        each = sizes.sum(axis=1)
        row = np.zeros(2 * size, np.int64)
        row[used] = np.arange(len(used))
        row = row[number]
        ids = _gather(flat, (np.cumsum(each) - each)[row], each[row])
        out = np.concatenate([[0], np.cumsum(each[row])])[begins]
        if whole:
            return self._put_whole(ids, out, whole)
        return ids, np.diff(out)

    def _with_odd(self, texts: pa.Array, odd: pa.Array, words: pa.Array, many: np.ndarray) -> tuple[pa.Array, np.ndarray, list]:
        """words and many with the chunks of odd texts in the place of the one empty chunk that they have; texts not to be cut, by number."""
        cut: list[list[str] | None] = []
        whole = []
        for i, (text, is_odd) in enumerate(zip(pc.if_else(odd, texts, "").to_pylist(), odd.to_pylist())):
            if is_odd and any(t in text for t in self.added):
                whole.append((i, text))
                is_odd = False
            cut.append(_GAP.split(text) if is_odd else None)
        loose = np.fromiter((len(c or ()) for c in cut), np.int64, len(cut))
        old_row = np.repeat(np.arange(len(cut)), many)
        many = many + np.maximum(loose - 1, 0)
        of_odd = loose[np.repeat(np.arange(len(cut)), many)] > 0
        spot = np.empty(len(of_odd), np.int64)
        spot[~of_odd] = np.flatnonzero(loose[old_row] == 0)
        spot[of_odd] = len(words) + np.arange(int(of_odd.sum()))
        return pa.concat_arrays([words, pa.array([c for one in cut for c in one or ()], words.type)]).take(pa.array(spot)), many, whole

    def _put_whole(self, ids: np.ndarray, upto: np.ndarray, whole: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """ids and sizes with those of the uncut texts, which have none so far."""
        out, sizes, last = [], np.diff(upto), 0
        for (i, _), own in zip(whole, self._whole([t for _, t in whole])):
            out += [ids[last : upto[i]], own]
            sizes[i], last = len(own), upto[i]
        return np.concatenate([*out, ids[last:]]), sizes

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, sizes) of spans of the texts, nulls as empty; a very long text comes alone, joined from parts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first, base = 0, 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, base + self.part_chars, side="right")))
            part = texts.slice(first, last - first)
            if ends[last - 1] - base > self.part_chars:
                pieces = [self.encode(pa.array([p], pa.large_string()))[0] for p in self._pieces(part[0].as_py())]
                ids = np.concatenate(pieces)
                yield first, last, ids, np.array([len(ids)])
            else:
                yield first, last, *self.encode(part)
            first, base = last, int(ends[last - 1])

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of a text, cut before a space that a non-space follows."""
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + max(1, self.part_chars // 4))
            while gap and any(t in text[max(0, gap.end() - len(t)) : gap.end() + len(t)] for t in self.added):
                gap = _GAP.search(text, gap.end())
            end = gap.start() if gap else len(text)
            yield text[at:end]
            at = end


def _byte_level(rules: dict) -> bool:
    """Do a tokenizer file's rules split texts as byte-level BPE does?"""
    split = rules.get("pre_tokenizer") or {}
    added = [t.get("content", "") for t in rules.get("added_tokens") or ()]
    return (
        split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not rules.get("normalizer")
        and not any(any(c.isspace() for c in t) for t in added) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in rules.get("added_tokens") or ())
    )


def _encoder(tokenizer_json: str) -> ChunkEncoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(tokenizer_json)
    return _ENCODERS[key]


def _schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    ids = pa.field("id", pa.from_numpy_dtype(dtype), nullable=False)
    return pa.schema([
        pa.field("input_ids", pa.list_(ids, seq_len), nullable=False),
        pa.field("mask", pa.list_(pa.field("on", pa.bool_(), nullable=False), seq_len), nullable=False),
    ])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _ShardWriter:
    def __init__(self, folder: str, name: str, dtype: np.dtype, seq_len: int, sequences: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.own = name, f".{name}-{uuid.uuid4().hex}"
        self.dtype, self.seq_len, self.full = dtype, seq_len, seq_len * sequences
        self.schema = _schema(dtype, seq_len)
        self.sinks = [self.fs.open_output_stream(f"{self.folder}/{self.own}.{kind}") for kind in ("ids", "docs")]
        self.ids = pa.ipc.new_stream(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_stream(self.sinks[1], _DOCS)
        self.pending: list[np.ndarray] = []
        self.held = self.written = 0
        self.n_docs = 0

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents one after another: their ids of the tokens, and how many each has."""
        starts = self.written + self.held + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(sizes.astype(np.int64))], schema=_DOCS))
        self.n_docs += len(sizes)
        while self.held + len(ids) >= self.full:
            room = self.full - self.held
            self.pending.append(ids[:room])
            ids = ids[room:]
            self._flush(self.full)
        if len(ids):
            self.pending.append(ids)
            self.held += len(ids)

    def _flush(self, real: int) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, self.dtype)
        n = -(-real // self.seq_len)
        ids = np.zeros(n * self.seq_len, self.dtype)
        ids[:real] = flat
        mask = np.zeros(n * self.seq_len, bool)
        mask[:real] = True
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), type=self.schema.field(i).type)
            for i, values in enumerate((ids, mask))
        ]
        self.ids.write_batch(pa.record_batch(columns, schema=self.schema))
        self.written += real
        self.pending, self.held = [], 0

    def close(self) -> tuple[str, int, int]:
        if self.held:
            self._flush(self.held)
        for x in (self.ids, self.docs, *self.sinks):
            x.close()
        for kind in ("docs", "ids"):
            self.fs.move(f"{self.folder}/{self.own}.{kind}", f"{self.folder}/{self.name}.{kind}.arrows")
        return self.name, self.n_docs, self.written


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    seq_len: int = SEQ_LEN,
    batch_sequences: int = BATCH_SEQUENCES,
) -> DataFrame:
    """Encode docs into shards under folder (a URI that executors can write).

    Returns the shards, one row each: shard, name, n_docs, n_tokens, base (ids of all shards
    before it).  The tokenizer file is read on the driver and sent to the executors; its size
    is checked.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        rules = f.read()
    if len(rules) > TOKENIZER_BYTES_MOST:
        raise ValueError(f"tokenizer file of {len(rules)} characters; at most {TOKENIZER_BYTES_MOST} are sent to executors")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(rules)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        for batch in batches:
            encoder = _encoder(sent.value)
            kind = np.dtype("<u2" if max(len(encoder.leads[" "]), end_id + 1) <= 1 << 16 else "<u4")
            for first, last, ids, sizes in encoder.parts(batch.column(1)):
                whole = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
                writer = writer or _ShardWriter(folder, f"shard-{shard:06d}", kind, seq_len, batch_sequences)
                writer.add(batch.column(0).slice(first, last - first), sizes + 1, whole)
        pa.default_memory_pool().release_unused()
        if writer:
            name, n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ranged = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first())  # many rows of one id are split too
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    table = scratch_path(spark, "token-shards")
    ranged.mapInArrow(write, "shard long, name string, n_docs long, n_tokens long").write.parquet(table)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return spark.read.parquet(table).withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _open(filesystem: pafs.FileSystem, path: str):
    return pa.memory_map(path) if isinstance(filesystem, pafs.LocalFileSystem) else filesystem.open_input_file(path)


def read_token_docs(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """Each document of the shards as the files have it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A task reads one shard batch by batch; no document is held whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with _open(filesystem, f"{top}/{row['name']}.ids.arrows") as ids_file, _open(filesystem, f"{top}/{row['name']}.docs.arrows") as docs_file:
                    spans = (s for b in pa.ipc.open_stream(docs_file) for s in zip(*(c.to_pylist() for c in b.columns)))
                    yield from _checked(pa.ipc.open_stream(ids_file), spans, row["base"])

    count = max(1, shards.count())
    spread = shards.select("name", "base").repartition(min(count, 10_000))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checked(batches, spans: Iterator[tuple], base: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    flat, begins = np.zeros(0, np.uint16), 0  # the batch at hand and the position of its first id
    for doc_id, start, n in spans:
        crc, at, end = 0, start, start + n
        while at < end:
            if at >= begins + len(flat):
                begins += len(flat)
                batch = batches.read_next_batch()
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[at - begins : end - begins]
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            at += len(part)
        out.append((doc_id, base + start, n, crc))
        if len(out) >= 10_000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])


class SequenceFile:
    """Random access to the sequences of one shard on a local disk, without copies.

    >>> ids, mask = SequenceFile(path)[17]   # doctest: +SKIP
    """

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.schema = pa.ipc.read_schema(self.map)
        self.first = self.map.tell()
        batch = self._at(self.first)
        self.per_batch = batch.num_rows if batch else 0
        self.stride = self.map.tell() - self.first

    def _at(self, offset: int) -> pa.RecordBatch | None:
        self.map.seek(offset)
        try:
            message = pa.ipc.read_message(self.map)
        except (EOFError, pa.ArrowInvalid):
            return None
        return pa.ipc.read_record_batch(message, self.schema)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        batch = self._at(self.first + i // self.per_batch * self.stride) if self.per_batch and i >= 0 else None
        if batch is None or i % self.per_batch >= batch.num_rows:
            raise IndexError(i)
        row = i % self.per_batch
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values
