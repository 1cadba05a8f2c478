"""SentencePiece encoding and decoding over a relational lattice.

Every different word of the corpus is exploded into its substrings of bounded
length, which meet the piece table in an equi-join; the edges are grouped by
word and folded by a higher-order aggregate: Viterbi for unigram models, the
merges of least rank for BPE models, whose scores are ranks and not
probabilities, so that a best path would not be the model's segmentation.
The cut words go back, once each, to the partitions of documents that hold
them, where the pieces' ids are put together.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyarrow import parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shared_path, table, whole_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Greatest length of a word in the lattice, as the fold keeps a word's cuts in the bits of one number.
#: Longer words (no blanks or signs in so many characters) go through the same merges where they stand.
LENGTH = 60
LONG = 256
EXTRA = 20_000
JOINT = "\x01"
LETTER = r"[^\W\d_]"
#: Different words that a task holds before it hands them on.
HELD = 200_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = 1 << 60


@dataclass
class Model:
    """Pieces by id with scores and kinds, and the flags of the normaliser."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    dummy_prefix: bool

    def usable(self) -> list[tuple[str, int, float]]:
        return [(p, i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k in (NORMAL, USER)]

    def byte_ids(self) -> list[int]:
        at = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        unknown = self.kinds.index(UNKNOWN)
        return [at.get(f"<0x{b:02X}>", unknown) for b in range(256)]


def _fields(data: bytes):
    """(field, wire type, value) of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, kind, data[at : at + n]
            at += n


def load_model(path: str = MODEL) -> Model:
    """Reads pieces, model type and the prefix flag from a model file."""
    with open(path, "rb") as f:
        data = f.read()
    out = Model([], [], [], UNIGRAM, True)
    for field, _, value in _fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for f, _, v in _fields(value):
                if f == 1:
                    piece = v.decode("utf-8")
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            out.pieces.append(piece)
            out.scores.append(score)
            out.kinds.append(kind)
        elif field == 2:
            out.kind = next((v for f, _, v in _fields(value) if f == 3), UNIGRAM)
        elif field == 3:
            out.dummy_prefix = bool(next((v for f, _, v in _fields(value) if f == 3), 1))
    return out


def escaped(text: str, dummy_prefix: bool = True) -> str:
    return (SPACE + text if dummy_prefix and text else text).replace(" ", SPACE)


def word_pattern(model: Model) -> re.Pattern:
    """Cuts an escaped text into words that no piece reaches across, so that each is encoded alone.

    A word is spaces, signs and then letters.  It ends before a space that no
    piece holds inside, after letters where no piece goes on from a letter to
    the sign that follows (signs that some piece joins so count as letters),
    and around a line feed, if that is in no longer piece.
    """
    pieces = [p for p, _, _ in model.usable() if len(p) > 1]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return re.compile("[\\s\\S]+")
    letter = re.compile(LETTER)
    joined = {b for p in pieces for a, b in zip(p, p[1:]) if letter.match(a) and not letter.match(b)}
    while more := {b for p in pieces for a, b in zip(p, p[1:]) if a in joined and not letter.match(b)} - joined:
        joined |= more
    glue = "".join(map(re.escape, sorted(joined)))
    cut = "" if any("\n" in p for p in pieces) else "\n"
    word = f"(?:{LETTER}|[{glue}])" if glue else LETTER
    sign = f"(?:(?![{SPACE}{cut}{glue}])[\\W\\d_])"
    return re.compile(f"{SPACE}*{sign}*{word}+|{SPACE}*{sign}+|{SPACE}+" + ("|\n" if cut else ""))


# The fold in Python, for words that no table has


def merge_word(word: str, rank: dict[str, float]) -> list[str]:
    """Pieces and single characters left by the merges of least rank, the leftmost first."""
    parts = list(word)
    if len(parts) > LONG:
        return _merge_long(parts, rank)
    get = rank.get
    ranks = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while ranks:
        r = min(ranks)
        if r == NEVER:
            break
        i = ranks.index(r)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], NEVER)
    return parts


def _merge_long(parts: list[str], rank: dict[str, float]) -> list[str]:
    """The same in n log n steps, with a heap over linked parts."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, str, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b or not a or not b:
            continue
        parts[i], parts[j] = a + b, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p]


def best_path(word: str, score: dict[str, float], longest: int) -> list[str]:
    """Viterbi: the pieces of greatest total score; a character without piece costs 10 below the least."""
    low = min(score.values(), default=0.0) - 10
    best, back = [0.0], [0]
    for j in range(1, len(word) + 1):
        top, at = max((best[i] + score.get(word[i:j], low if j - i == 1 else float("-inf")), -i) for i in range(max(0, j - longest), j))
        best.append(top)
        back.append(-at)
    out, j = [], len(word)
    while j:
        out.append(word[back[j] : j])
        j = back[j]
    return out[::-1]


class Encoder(dict):
    """word -> ids of the word after a space, as packed 32-bit integers; `inner` has parts that follow no space.

    Most words are looked up whole; one that isn't there is cut into its parts,
    and a part that isn't there goes through the fold.  What was found on the
    way is kept until there is too much of it.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.inner = {}
        self.ids = {p: i for p, i, _ in model.usable()}
        self.packed_ids = {p: struct.pack("i", i) for p, i in self.ids.items()}
        self.values = {p: (-s if model.kind == BPE else s) for p, _, s in model.usable()}
        self.bytes, self.words = model.byte_ids(), word_pattern(model).findall
        self.kind, self.longest, self.extra = model.kind, max(map(len, self.values), default=1), []
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.values)

    def packed(self, parts: list[str]) -> bytes:
        """Ids of pieces; a character that is no piece counts as its bytes."""
        try:
            return b"".join(map(self.packed_ids.__getitem__, parts))
        except KeyError:
            return b"".join(self.packed_ids.get(p) or array("i", [self.bytes[b] for b in p.encode("utf-8")]).tobytes() for p in parts)

    def learn(self, cut: list[str]) -> None:
        """Takes in words cut by the lattice."""
        packed, inner = self.packed, self.inner
        for c in cut:
            parts = c.split(JOINT)
            word = "".join(parts)
            if word[0] == SPACE:
                self[word[1:]] = packed(parts)
            else:
                inner[word] = packed(parts)

    def keep(self, store: dict, word: str, packed: bytes) -> bytes:
        if len(self.extra) >= EXTRA:
            for d, w in self.extra:
                d.pop(w, None)
            self.extra.clear()
        if len(word) <= LONG:
            self.extra.append((store, word))
            store[word] = packed
        return packed

    def __missing__(self, word: str) -> bytes:
        parts = self.words(SPACE + word)
        return self.keep(self, word, self.fold(parts[0]) if len(parts) == 1 else b"".join(map(self.part, parts)))

    def free(self) -> None:
        """Lets go of everything; what is kept refers to the encoder itself, so it would wait for a collection."""
        self.extra.clear()
        self.inner.clear()
        self.clear()

    def part(self, part: str) -> bytes:
        """Ids of a part as it stands in an escaped text."""
        store, key = (self, part[1:]) if part[0] == SPACE else (self.inner, part)
        packed = store.get(key)
        return self.keep(store, key, self.fold(part)) if packed is None else packed

    def fold(self, part: str) -> bytes:
        return self.packed(merge_word(part, self.values) if self.kind == BPE else best_path(part, self.values, self.longest))

    def encode(self, text: str, dummy_prefix: bool) -> np.ndarray:
        if self.cuts and dummy_prefix and plain(text):
            packed = b"".join(map(self.__getitem__, text.split(" ")))
        else:
            packed = b"".join(map(self.part, self.words(escaped(text, dummy_prefix))))
        return np.frombuffer(packed, dtype=np.int32)


def plain(text: str) -> bool:
    """Whether the words are what stands between single spaces."""
    return text != "" and text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text


def piece_bytes(model: Model) -> list[bytes]:
    """What each id adds to a decoded text; control pieces add nothing."""
    out = []
    for p, k in zip(model.pieces, model.kinds):
        out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode("utf-8"))
    return out


def decode_ids(ids, parts: list[bytes], dummy_prefix: bool) -> str:
    text = b"".join(map(parts.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if dummy_prefix and text.startswith(" ") else text


# The lattice


def ranks(model: Model) -> dict[str, int]:
    """Place of each piece by falling score; equal scores have equal places."""
    order = {s: k for k, s in enumerate(sorted({-s for _, _, s in model.usable()}))}
    return {p: order[-s] for p, _, s in model.usable()}


def irregular(model: Model) -> list[str]:
    """Pieces that one pass over their merges by rank doesn't put together.

    Without such a piece among its edges, a word's merges come by growing
    rank: a piece that becomes possible only after a merge of greater rank
    would, within its own bounds, have been merged before.
    """
    rank = ranks(model)

    def whole(word: str) -> bool:
        n = len(word)
        cuts = set(range(n + 1))
        for _, i, j in sorted((rank[word[i:j]], i, j) for i in range(n) for j in range(i + 2, n + 1) if word[i:j] in rank):
            inner = [k for k in range(i + 1, j) if k in cuts]
            if i in cuts and j in cuts and len(inner) == 1:
                cuts.discard(inner[0])
        return len(cuts) == 2

    return [p for p in rank if len(p) > 1 and not whole(p)]


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """word, edges and the other columns of the table, for its distinct words: an edge for each piece found in the word.

    For BPE an edge is the number rank << 12 | start << 6 | length of a piece
    of two characters or more; for unigram a struct (value, start, length)
    with minus the score.  The piece table is as large as the model file, so
    it is broadcast; the keys are hashes, as joins on numbers are several
    times faster, and what meets is compared.  An empty substring stands for the word itself: it
    carries the other columns and keeps words without edges.  Grouping needs
    no exchange where the table is already partitioned by word.
    """
    spark, bpe = words.sparkSession, model.kind == BPE
    rank = ranks(model)
    usable = [(p, rank[p], float(-s)) for p, _, s in model.usable()] + [("", -1, 0.0)]
    longest, least = max(len(p) for p, _, _ in usable), 2 if bpe else 1
    pieces = F.broadcast(spark.createDataFrame(usable, "piece string, rank long, value double").withColumn("key", F.xxhash64("piece")))
    others = [c for c in words.columns if c != "word"]
    spot = words.withColumn("start", F.explode(F.sequence(F.lit(-1), F.char_length("word") - least)))
    lengths = F.when(F.col("start") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(least), F.least(F.lit(longest), F.char_length("word") - F.col("start"))))
    spot = spot.select("word", "start", *[F.when(F.col("start") < 0, F.col(c)).alias(c) for c in others], F.explode(lengths).alias("length"))
    part = F.expr("substring(word, start + 1, length)")
    found = spot.withColumn("key", F.xxhash64(part)).join(pieces, "key").where((part <= F.col("piece")) & (part >= F.col("piece")))
    edge = F.col("rank") * 4096 + F.col("start") * 64 + F.col("length") if bpe else F.struct("value", "start", "length")
    return found.groupBy("word").agg(F.collect_list(F.when(F.col("start") >= 0, edge)).alias("edges"), *[F.max(c).alias(c) for c in others])


#: SQL: cuts of a word as bits, folded from all of them: an edge of the next rank joins its two parts if it has just two.
_ENDS = "(shiftleft(1L, cast(shiftright(e, 6) & 63 as int)) | shiftleft(1L, cast((shiftright(e, 6) & 63) + (e & 63) as int)))"
_SPAN = "shiftleft(shiftleft(1L, cast(e & 63 as int) + 1) - 1L, cast(shiftright(e, 6) & 63 as int))"
_ONE_PASS = f"aggregate(sort_array(edges), shiftleft(1L, n + 1) - 1L, (b, e) -> if((b & {_ENDS}) = {_ENDS} and bit_count(b & {_SPAN}) = 3, b & ({_ENDS} | ~{_SPAN}), b))"
_ONE_PASS_STARTS = f"transform(array({_ONE_PASS}), b -> filter(sequence(0, n - 1), i -> getbit(b, i) = 1))[0]"


def _merged_starts() -> str:
    """SQL: starts of the parts of a word, folded from its characters by the merges of least rank, searched anew each time."""
    best = (
        "array_min(filter(spans, e -> array_contains(b, e.start) and (e.start + e.length = n or array_contains(b, e.start + e.length))"
        " and size(filter(b, x -> x >= e.start and x < e.start + e.length)) = 2))"
    )
    step = f"transform(array({best}), e -> if(e is null, b, filter(b, x -> x <= e.start or x >= e.start + e.length)))[0]"
    spans = "transform(edges, e -> named_struct('value', shiftright(e, 12), 'start', cast(shiftright(e, 6) & 63 as int), 'length', cast(e & 63 as int)))"
    return f"transform(array({spans}), spans -> aggregate(sequence(1, n), sequence(0, n - 1), (b, k) -> {step}))[0]"


def _path_starts(low: float) -> str:
    """SQL: starts of the parts on the path of least total value, by a Viterbi fold and a walk back."""
    ending = f"concat(filter(edges, e -> e.start + e.length = p), array(named_struct('value', {low}D, 'start', p - 1, 'length', 1)))"
    forward = f"aggregate(sequence(1, n), array(named_struct('cost', 0D, 'start', 0)), (s, p) -> concat(s, array(array_min(transform({ending}, e -> named_struct('cost', s[e.start].cost + e.value, 'start', e.start))))))"
    return f"transform(array({forward}), s -> aggregate(sequence(1, n), array(n), (b, k) -> if(b[0] = 0, b, concat(array(s[b[0]].start), b)), b -> filter(b, x -> x < n)))[0]"


def cut_words(words: DataFrame, model: Model) -> DataFrame:
    """word, parts (array of its pieces and single characters), other columns, for distinct words of 1 to LENGTH characters."""
    if model.kind == BPE:
        odd = irregular(model)
        holds_odd = " or ".join(f"contains(word, '{p}')" for p in odd if "'" not in p and "\\" not in p) if len(odd) < 100 and not any("'" in p or "\\" in p for p in odd) else "true"
        starts = f"if({holds_odd}, {_merged_starts()}, {_ONE_PASS_STARTS})" if odd else _ONE_PASS_STARTS
    else:
        starts = _path_starts(10 - min((s for _, _, s in model.usable()), default=0.0))
    folded = lattice(words, model).withColumn("n", F.char_length("word")).withColumn("starts", F.expr(starts))
    parts = "transform(starts, (s, i) -> substring(word, s + 1, coalesce(get(starts, i + 1), n) - s))"
    return folded.withColumn("parts", F.expr(parts)).drop("edges", "n", "starts")


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """word, ids for the distinct words, of 1 to LENGTH characters each, of the table."""

    def run(batches):
        encoder = Encoder(model)
        for batch in batches:
            ids = [np.frombuffer(encoder.packed(parts), np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return cut_words(words.select("word"), model).select("word", "parts").mapInArrow(run, "word string, ids array<int>")


def words_of_partitions(docs: DataFrame, model: Model) -> DataFrame:
    """word, pid: the different words of every partition of docs(text), a partition's words handed on in portions."""

    def run(batches):
        pid, findall, plain_words, words = TaskContext.get().partitionId(), word_pattern(model).findall, set(), set()

        def portion():
            for w in plain_words:  # each different one is cut once; one of letters alone is a word
                if w.isalpha():
                    words.add(SPACE + w)
                else:
                    words.update(findall(SPACE + w))
            kept = [w for w in words if len(w) <= LENGTH and JOINT not in w]
            plain_words.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(np.full(len(kept), pid, np.int32))], names=["word", "pid"])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(i, 64).to_pylist():
                    if model.dummy_prefix and plain(text):
                        plain_words.update(text.split(" "))
                    else:
                        words.update(findall(escaped(text, model.dummy_prefix)))
                if len(plain_words) + len(words) > HELD:
                    yield portion()
        yield portion()

    return docs.where("text is not null and text <> ''").select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, pid int")


def cut_table(docs: DataFrame, model: Model) -> str:
    """Writes the cut words of docs' partitions to the shared folder, and returns the place.

    One exchange brings the partitions of each word together, and one brings
    the cut word back to them: folder pid=i holds those of partition i, and
    pid=-1 those that more than half of the partitions hold.  Those are fewer
    than twice the different words of an average partition, however many
    partitions there are.  A word's list of partitions is as long as their
    number at most.
    """
    rows = docs.select("text")
    count = rows.rdd.getNumPartitions()
    held = words_of_partitions(rows, model).groupBy("word").agg(F.collect_set("pid").alias("pids"))
    cut = cut_words(held, model)
    to = F.when(F.size("pids") * 2 > count, F.array(F.lit(-1))).otherwise(F.col("pids"))
    sent = cut.select(F.explode(to).alias("pid"), F.array_join("parts", JOINT).alias("cut"))
    path = shared_path(docs.sparkSession, "pieces")
    part = F.when(F.col("pid") < 0, F.pmod(F.xxhash64("cut"), F.lit(16))).otherwise(0)  # the shared ones are many for one task
    sent.repartition("pid", part).write.partitionBy("pid").parquet(path)
    return path


def read_cut(path: str, pid: int):
    """The cut words of one folder, as lists of bounded length, read wherever the task runs."""
    files, root = pa_fs.FileSystem.from_uri(f"{path}/pid={pid}") if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), f"{path}/pid={pid}")
    found = files.get_file_info(pa_fs.FileSelector(root, allow_not_found=True))
    for f in sorted(i.path for i in found if i.path.endswith(".parquet")):
        with files.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1 << 14, columns=["cut"]):
                yield batch.column(0).to_pylist()


def encode(docs: DataFrame, *, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip for every row.

    The whole text is encoded, of any length; round_trip tells whether
    decoding gives it back, which fails only for texts that hold the escape
    character itself.  Null texts have null ids and round_trip, and 0 pieces;
    empty ones no ids.  Null doc_ids and repeated rows are encoded like
    others; ties between merges go to the leftmost; other columns are not
    read, whatever their names; an empty table gives no rows.  docs is read
    twice and should give the same partitions each time, as a stored table
    does: a word that isn't in its partition's table goes through the same
    fold where it stands.
    """
    whole_texts(docs.sparkSession)
    model = load_model(model_path)
    path = cut_table(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        model, pid = Model(**shared.value), TaskContext.get().partitionId()
        encoder, parts = Encoder(model), piece_bytes(model)
        for place in (-1, pid):
            for cut in read_cut(path, place):
                encoder.learn(cut)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(1).to_pylist()
                got = [None if t is None else encoder.encode(t, model.dummy_prefix) for t in texts]
                same = [None if t is None else decode_ids(x.tolist(), parts, model.dummy_prefix) == t for t, x in zip(texts, got)]
                sizes = np.array([0 if x is None else len(x) for x in got], dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([x is None for x in got] + [False]))
                flat = np.concatenate([x for x in got if x is not None]) if any(x is not None for x in got) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])
        encoder.free()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, *, model_path: str = MODEL) -> DataFrame:
    """encoded(doc_id, ids) as doc_id, text; null ids give a null text."""
    model = load_model(model_path)
    parts, prefix = piece_bytes(model), model.dummy_prefix

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode_ids(x, parts, prefix) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
