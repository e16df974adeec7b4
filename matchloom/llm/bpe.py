"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

Encoding. Every partition splits its texts into pre-tokens, block by block. A pre-token that the rank table holds whole
is its own id. Every other pre-token of a block is named once, with its number in the block. A shuffle by the hash of
the pre-token, which moves those of one block and bucket as one packed row, and a sort bring equal ones together; each
distinct pre-token is encoded once, and its ids go back to all blocks that asked. A block's pre-tokens, written as ids
and numbers by position, meet these answers in a second shuffle, where the texts are reassembled. A pre-token asks once
a block however often it stands there, so no key has more rows than there are blocks.

A block closes at ``BLOCK_CHARS`` characters, so a task gathers at most that and its last text. Its key is its partition
and its place in it, so no two blocks share one. Blocks are made twice, once for their questions and once for their
positions, as storing them would write the positions twice; both times they are sealed by a hash of the whole block, and
a mismatch (an input that reads differently the second time) fails the job.

Decoding. The ids of about ``CHUNK_IDS`` positions are followed by their distinct ids, one a row; these are joined with
the token-byte table, which is broadcast, as its size is the vocabulary's, and the bytes found are put back by position.
Nothing is shuffled, so a chunk's rows stay together; a chunk that lacks one fails the job.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids decode to null. Repeated rows are
encoded row by row; nulls in any kept column pass through; other columns are ignored. Ids outside the table fail the
decoding.
"""

from __future__ import annotations

import base64
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import give_back, map_batches, read_table

BLOCK_CHARS, CHUNK_IDS, ANSWERS = 4_000_000, 1_000_000, 200_000

# White space as the tokenizer's library has it; letters and numbers below U+0250 spelled out, as the faster splitter
# needs them. Texts with characters above go through the general pattern, which gives the same pieces.
_SPACE = r"\t-\r \x85\xa0"
_WIDE_SPACE = _SPACE + r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"


def _pattern(letter: str, number: str, space: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


_NARROW = re.compile(_pattern(_LETTER, _NUMBER, _SPACE))
_WIDE = regex.compile(_pattern(r"\p{L}", r"\p{N}", _WIDE_SPACE))
_BEYOND = re.compile("[^\x00-ɏ]")


def pretokens(text: str) -> list[str]:
    return (_WIDE if _BEYOND.search(text) else _NARROW).findall(text)


def _pieces(text: str, most: int = 1_000_000):
    """The pre-tokens of a text in Arrow arrays of at most ``most`` of them."""
    if len(text) <= most:
        yield pa.array(pretokens(text), pa.string())
        return
    found = (_WIDE if _BEYOND.search(text) else _NARROW).finditer(text)
    while part := [m[0] for m in islice(found, most)]:
        yield pa.array(part, pa.string())


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """The tokenizer's library with the pattern that takes a pre-token whole."""
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class Table:
    """What tasks share of the rank table: the tokens that are valid text, and all merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values(), default=-1) + 1
        self._open = None

    def __getstate__(self):
        return {"ranks": self.ranks, "size": self.size, "_open": None}

    def whole(self) -> tuple[pa.Array, np.ndarray]:
        """Tokens that are valid UTF-8, and their ids."""
        if self._open is None:
            words, ids = [], []
            for token, i in self.ranks.items():
                try:
                    words.append(token.decode())
                    ids.append(i)
                except UnicodeDecodeError:
                    continue
            self._open = pa.array(words, pa.string()), np.array(ids, "<u4")
        return self._open


_ZSTD = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _compress(raw: bytes) -> bytes:
    return _ZSTD[0].compress(raw)


def _expand(raw: bytes) -> bytes:
    return _ZSTD[1].decompress(raw)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte plane by byte plane, compressed."""
    return _compress(b"".join(np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns))


def _unsqueeze(packed: bytes, *sizes: int) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(_expand(packed), np.uint8), [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def _blocks(batches, text: str, table: Table, most: int):
    """(key, seal, kept rows, ends, codes, asked words) of each block of texts.

    A code below ``table.size`` is an id; one above it is, less the size, the number of an asked word.
    """
    part, serial = TaskContext.get().partitionId(), 0
    rows, ends, pieces, chars, n = [], [], [], 0, 0
    known, ids = table.whole()

    def close():
        nonlocal rows, ends, pieces, chars, n, serial
        parts = pa.chunked_array(pieces, pa.string()).combine_chunks()
        found = pc.index_in(parts, value_set=known)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        codes = ids[found.fill_null(0).to_numpy()] if len(ids) else np.zeros(len(parts), "<u4")
        rest = parts.filter(pa.array(missing)).dictionary_encode()
        which, words = rest.indices.to_numpy(), rest.dictionary
        order = np.argsort(-np.bincount(which, minlength=len(words)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        codes[missing] = table.size + number[which]
        words = words.take(pa.array(order))
        seal = xxhash.xxh64(codes.tobytes())
        seal.update(np.asarray(ends, "<u8").tobytes())
        for buffer in words.buffers()[1:]:
            seal.update(buffer or b"")
        kept = pa.concat_arrays(rows)
        out = part << 32 | serial, int(np.array([seal.intdigest()], np.uint64).view(np.int64)[0]), kept, np.asarray(ends, "<u4"), codes.astype("<u4"), words
        serial += 1
        rows, ends, pieces, chars, n = [], [], [], 0, 0
        return out

    for b in batches:
        at, texts = 0, b.column(text).to_pylist()
        keep = pa.StructArray.from_arrays([b.column(c) for c in b.schema.names if c != text] or [pa.nulls(b.num_rows, pa.int8())], names=[c for c in b.schema.names if c != text] or ["_"])
        for i, t in enumerate(texts):
            for piece in _pieces(t) if t else ():
                pieces.append(piece)
                n += len(piece)
            ends.append(n)
            chars += len(t or "")
            if chars >= most:
                rows.append(keep.slice(at, i + 1 - at))
                at = i + 1
                yield close()
        if at < len(texts):
            rows.append(keep.slice(at))
    if ends:
        yield close()


#: A chunk of encoded texts: one row that packs them, followed by a row for each distinct id among them.
_CHUNK = ("kept", "sizes", "ids", "distinct", "token")


def _chunk(kept: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> pa.Table:
    """The rows of one chunk: ``sizes`` is the number of ids of each text, -1 for a null list."""
    seen = np.unique(ids)
    first = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([sizes.astype("<i8").tobytes()], pa.binary()), pa.array([ids.astype("<i4").tobytes()], pa.binary()), pa.array([len(seen)], pa.int32())]
    columns = [*(pa.chunked_array([a, pa.nulls(len(seen), a.type)]) for a in first), pa.chunked_array([pa.nulls(1, pa.int32()), pa.array(seen, pa.int32())])]
    return pa.table(columns, names=list(_CHUNK))


def _met(docs: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...], assemble, out: str) -> DataFrame:
    """Blocks of ``docs`` and the ids of the words they ask for, handed to ``assemble`` block by block."""
    rows = docs.select(*keep, "text")
    shared, most = docs.sparkSession.sparkContext.broadcast(Table(ranks)), BLOCK_CHARS  # the vocabulary
    # several buckets a partition even out their sizes; a block has at most one row in each
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def ask(batches):
        for key, seal, *_, words in _blocks(batches, "text", shared.value, most):
            order = pc.sort_indices(words)  # neighbours compress well
            asked, at = words.take(order), order.to_numpy()
            bucket = np.array([xxhash.xxh64_intdigest(w) % buckets for w in asked.to_pylist()], np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1)) if len(by) else np.zeros(1, int)
            # the empty word, which no text has, carries the seal
            rows = [(key, seal, key % buckets, 0, b"", b"")]
            for i, j in zip(cuts[:-1], cuts[1:]):
                mine = asked.take(pa.array(by[i:j]))
                sizes = pc.binary_length(mine).to_numpy()
                rows.append((key, None, int(bucket[by[i]]), j - i, _squeeze(at[by[i:j]], sizes), _compress("".join(mine.to_pylist()).encode())))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), packed)], names=["block", "seal", "bucket", "n", "at", "words"])

    def unpack(batches):
        for b in batches:
            for key, seal, _, n, at, words in zip(*(c.to_pylist() for c in b.columns)):
                if not n:
                    places, named = pa.array([seal], pa.int64()), pa.array([""], pa.string())
                else:
                    places, sizes = _unsqueeze(at, n, n)
                    places = pa.array(places.astype(np.int64))
                    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
                    named = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends), pa.py_buffer(_expand(words))])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key, pa.int64()), len(places)), places, named], names=["block", "at", "word"])

    def answer(batches):
        merge = encoding(shared.value.ranks).encode_ordinary

        def out(held):
            rows = pa.Table.from_batches(held)
            coded = rows.column("word").combine_chunks().dictionary_encode()  # rows of one word come together
            ids = [merge(w) for w in coded.dictionary.to_pylist()]
            which, size = coded.indices.to_numpy(), np.array([len(x) for x in ids])
            flat, ends = np.array([i for x in ids for i in x], "<u4"), np.cumsum(size)
            block, at = rows.column("block").to_numpy(), rows.column("at").to_numpy()
            real = size[which] > 0
            seals = pa.RecordBatch.from_arrays([pa.array(block[~real]), pa.array(at[~real]), *(pa.nulls((~real).sum(), t) for t in (pa.int32(), pa.int32(), pa.binary()))], names=names)
            order = np.lexsort((at, block))
            order = order[real[order]]
            block, at, which = block[order], at[order], which[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            packed = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                w = which[i:j]
                n = size[w]
                mine = flat[np.repeat(ends[w] - np.cumsum(n), n) + np.arange(n.sum())]
                packed.append((block[i], None, j - i, n.sum(), _squeeze(np.diff(at[i:j], prepend=0), n, mine)))
            cols = [pa.array(list(c), t) for c, t in zip(zip(*packed), types)] if packed else [pa.array([], t) for t in types]
            return seals, pa.RecordBatch.from_arrays(cols, names=names)

        names, types = ["block", "seal", "words", "size", "ids"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ANSWERS:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    def places(batches):
        for key, seal, kept, ends, codes, words in _blocks(batches, "text", shared.value, most):
            cols = [pa.array([key], pa.int64()), pa.array([seal], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([_squeeze(np.diff(ends, prepend=0))], pa.binary()), pa.array([len(codes)], pa.int64()), pa.array([_squeeze(codes)], pa.binary()), pa.array([len(words)], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "seal", "rows", "sizes", "n", "codes", "words"])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        seals = right.column("seal").drop_null().to_pylist()
        parts = [_unsqueeze(x, w, w, n) for x, w, n in zip(right.column("ids").to_pylist(), right.column("words").to_pylist(), right.column("size").to_pylist()) if x is not None]
        at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p[0]) for p in parts)]).astype(np.int64)
        if left.num_rows != 1 or seals != left.column("seal").to_pylist() or not np.array_equal(np.sort(at), np.arange(left.column("words")[0].as_py())):
            raise ValueError("a block was made differently the second time; checkpoint the input first")
        size = np.concatenate([np.zeros(0, "<u4"), *(p[1] for p in parts)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, "<u4"), *(p[2] for p in parts)])
        counts, starts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        counts[at], starts[at] = size, np.cumsum(size) - size
        kept = left.column("rows").combine_chunks().flatten()
        (codes,) = _unsqueeze(left.column("codes")[0].as_py(), left.column("n")[0].as_py())
        (sizes,) = _unsqueeze(left.column("sizes")[0].as_py(), len(kept))
        done = assemble(shared.value.size, kept, codes, sizes, starts, counts, flat)
        give_back()
        return done

    chunks = map_batches(rows, ask, "block long, seal long, bucket long, n int, at binary, words binary").repartition("bucket")
    asked = map_batches(chunks, unpack, "block long, at long, word string").sortWithinPartitions("word")
    answers = map_batches(asked, answer, "block long, seal long, words int, size int, ids binary", rows=10_000)
    blocks = map_batches(rows, places, f"block long, seal long, rows array<{_kept_kind(docs, keep)}>, sizes binary, n long, codes binary, words int")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(gather, out)


def _numbers(size: int, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of ids of each code."""
    return np.concatenate([np.ones(size, np.int64), counts])[codes]


def encode_chunks(docs: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The encoded rows of ``docs`` in chunks, as ``decode_chunks`` takes them."""

    def ids(size, kept, codes, sizes, starts, counts, flat):
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        parts = [np.zeros(0, np.int32)]
        step = np.zeros(len(codes) + 1, np.int64)
        step[1:] = np.cumsum(_numbers(size, codes, counts))
        ends = step[bounds[1:]] - step[bounds[:-1]]
        for i in range(0, len(codes), 200_000):  # little at a time, as ids take several times a code's room
            code = codes[i : i + 200_000].astype(np.int64)
            n = np.diff(step[i : i + len(code) + 1])
            asked = code >= size
            out = np.repeat(np.where(asked, 0, code), n)
            if asked.any():
                from_ = starts[code[asked] - size]
                m = n[asked]
                out[np.repeat(asked, n)] = flat[np.repeat(from_ - np.cumsum(m) + m, m) + np.arange(m.sum())]
            parts.append(out.astype(np.int32))
        return _chunk(kept, ends, np.concatenate(parts))

    return _met(docs, ranks, keep, ids, f"kept array<{_kept_kind(docs, keep)}>, sizes binary, ids binary, distinct int, token int")


def _kept_kind(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return "struct<" + (", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in keep) or "_: tinyint") + ">"


def encode(docs: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and token_ids (array of int) of every row of ``docs``."""

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                size, ids = np.frombuffer(b.column(1)[i].as_py(), "<i8"), np.frombuffer(b.column(2)[i].as_py(), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), lists], names=["kept", "token_ids"])

    chunks = encode_chunks(docs, ranks, keep).where("sizes is not null").select("kept", "sizes", "ids")
    return map_batches(chunks, unpack, f"kept {_kept_kind(docs, keep)}, token_ids array<int>").select(*(F.col(f"kept.`{c}`").alias(c) for c in keep), "token_ids")


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id",), name: str = "n_tokens") -> DataFrame:
    """The ``keep`` columns and the number of token ids of every row of ``docs``."""

    def number(size, kept, codes, sizes, starts, counts, flat):
        total = np.concatenate([[0], np.cumsum(_numbers(size, codes, counts))])
        done = np.diff(total[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])])
        return pa.table([*(kept.field(c) for c in keep), pa.array(done, pa.int64())], names=[*keep, name])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return _met(docs, ranks, keep, number, f"{fields}`{name}` long")


def token_bytes(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The token-byte table: token (its id) and bytes."""
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def join_tokens(lists: pa.Array, tokens: pa.Array, data: pa.Array) -> pa.Array:
    """The concatenated bytes of each list of ids, as the table of ``tokens`` and their bytes ``data`` has them."""
    picked = data.take(pc.index_in(lists.flatten(), value_set=tokens))
    if picked.null_count:
        raise ValueError("an id has no token")
    _, offsets, content = picked.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(picked) + 1] if len(picked) else np.zeros(1, np.int64)
    bounds = at[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)]
    if bounds[-1] > 0x7FFFFFFF:
        raise ValueError("a chunk decodes to more than 2 GB")
    whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int32)), content or pa.py_buffer(b"")])
    return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary())) if lists.null_count else whole


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that the token-byte table has for ``token_ids``."""
    keep = [c for c in encoded.columns if c != "token_ids"]
    kept = F.struct(*keep) if keep else F.struct(F.lit(0).cast("tinyint").alias("_"))
    rows = encoded.select(kept.alias("kept"), F.col("token_ids").cast("array<int>").alias("token_ids"))
    most = CHUNK_IDS

    def pack(batches):
        held, n = [], 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("token_ids").combine_chunks()
            size = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
            yield from _chunk(t.column("kept").combine_chunks(), size, lists.flatten().fill_null(-1).to_numpy()).to_batches()

        for b in batches:
            held.append(b)
            n += len(b.column(1).flatten())
            if n >= most:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()

    chunks = map_batches(rows, pack, f"kept array<{rows.schema['kept'].dataType.simpleString()}>, sizes binary, ids binary, distinct int, token int")
    return decode_chunks(chunks, ranks)


def decode_chunks(chunks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The kept columns, token_ids and ``decoded`` of every text in ``chunks``."""
    kept = chunks.schema["kept"].dataType.elementType
    kind, keep = kept.simpleString(), [c for c in kept.names if c != "_"]

    def fold(batches):
        chunk, tokens, data = None, [], []

        def out():
            if sum(map(len, tokens)) != chunk["distinct"][0].as_py():
                raise ValueError("the rows of a chunk came apart")
            size, ids = np.frombuffer(chunk["sizes"][0].as_py(), "<i8"), np.frombuffer(chunk["ids"][0].as_py(), "<i4")
            ends = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=pa.array(size < 0))
            table = pa.concat_arrays(tokens) if tokens else pa.array([], pa.int32()), pa.concat_arrays(data).cast(pa.large_binary()) if data else pa.array([], pa.large_binary())
            return pa.RecordBatch.from_arrays([chunk["kept"].combine_chunks().flatten(), lists, join_tokens(lists, *table)], names=["kept", "token_ids", "decoded"])

        for b in batches:
            heads = np.flatnonzero(b.column("sizes").is_valid())
            for i, j in zip([0, *heads], [*heads, b.num_rows]):
                part = b.slice(i, j - i)
                if i in heads and j > i:
                    if chunk is not None:
                        yield out()
                    chunk, tokens, data = pa.Table.from_batches([part.slice(0, 1)]), [], []
                    part = part.slice(1)
                if part.num_rows:
                    tokens.append(part.column("token"))
                    data.append(part.column("bytes"))
        if chunk is not None:
            yield out()

    joined = chunks.join(F.broadcast(token_bytes(chunks.sparkSession, ranks)), "token", "left").select("kept", "sizes", "ids", "distinct", "token", "bytes")
    folded = map_batches(joined, fold, f"kept {kind}, token_ids array<int>, decoded binary", rows=10_000)
    return folded.select(*(F.col(f"kept.`{c}`").alias(c) for c in keep), "token_ids", "decoded")


def public_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_ranks()
    both = decode_chunks(encode_chunks(read_table(spark, sf_dir, "documents"), ranks), ranks)
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
