"""SentencePiece encoding and decoding of whole texts over suffix arrays.

Encoding of a batch: the distinct stretches (white space and the word after it) are laid out as one
text of alphabet codes. Its suffix array is searched for every piece of the vocabulary, which
gives the range of its occurrences; these are edges from one position to another. The edges are sorted by
end position and relaxed for all stretches at once: at each position one edge survives, the
one whose piece may follow the piece that ends where it starts. Two pieces may stand side by side when
merging best pairs first, as byte-pair models do, never joins across their border. So the path is
that of the merges, without running them.

Stretches that a worker has encoded before are not laid out again: their pieces are kept, up to a bounded size.

Null gives null, an empty text no pieces. Characters without a piece become byte pieces. As in the
format itself the character U+2581 stands for a space, so it comes back as one; every other text comes back
exactly. The vocabulary is a file whose path is a parameter; it is read on the driver and
broadcast, with a size that no data changes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import U, Words, text_runs
from anamnesis.llm.common import send_code

SPACE = "▁"
#: Bytes of text whose distinct stretches are indexed together.
INDEX_BYTES = 1 << 19
#: Stretches, and pieces of stretches, that a worker keeps; beyond, it begins anew.
KEPT_STRETCHES, KEPT_PIECES = 1 << 19, 1 << 22
#: Bytes that end a word: controls and space.
INSIDE = np.arange(256) > 0x20


class Vocabulary:
    """Pieces by id, their alphabet codes, the pairs that merge, and how each piece came about."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.bytes: list[bytes] = []
        plain: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                plain[piece] = i
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.runs = {len(p): i for p, i in plain.items() if set(p) == {SPACE}}
        self.space = plain[SPACE]
        plain = {p: i for p, i in plain.items() if i == self.space or i not in self.runs.values()}
        if any(SPACE in p[1:] for p in plain):
            raise ValueError("pieces with a space inside are not supported")

        letters = sorted({p for p in plain if len(p) == 1})
        self.code = np.zeros(0x110000, dtype=np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.code[ord(" ")] = self.code[ord(SPACE)]
        self.letter = np.full(len(letters) + 1, -1, dtype=np.int32)
        self.letter[1:] = [plain[c] for c in letters]

        rank = {p: -model.get_score(i) for p, i in plain.items()}
        self.rank = np.full(size, np.inf)
        parts: dict[str, tuple[str, str]] = {}
        for p in plain:
            self.rank[plain[p]] = rank[p] if len(p) > 1 else -np.inf
            if len(p) > 1:
                last = self._last_merge(p, rank)
                if last is not None:
                    parts[p] = last
        made = {p for p in plain if len(p) == 1 or p in parts}
        # Spines: what stands at the border while a piece is being put together, largest first.
        self.right, self.right_up = self._spines(plain, parts, rank, made, 1)
        self.left, self.left_up = self._spines(plain, parts, rank, made, 0)
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in made and p[k:] in made:
                    pairs[plain[p[:k]] * size + plain[p[k:]]] = i
        self.size = size
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.joined = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int32)
        found = sorted(made)
        self.width = max(len(p) for p in found)
        self.piece_ids = np.array([plain[p] for p in found], dtype=np.int32)
        self.piece_len = np.array([len(p) for p in found], dtype=np.int32)
        table = np.zeros((len(found), self.width), dtype=np.uint16)
        for k, p in enumerate(found):
            table[k, : len(p)] = self.code[[ord(c) for c in p]]
        self.low = _keys(table)
        table[table == 0] = 0xFFFF
        self.high = _keys(table)
        self.length = np.zeros(size, dtype=np.int32)
        self.length[self.piece_ids] = self.piece_len

    @staticmethod
    def _last_merge(piece: str, rank: dict[str, float]) -> tuple[str, str] | None:
        """The two parts that the last merge of ``piece`` alone joins; None if it isn't reached."""
        parts = list(piece)
        while True:
            options = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
            if not options:
                return None
            k = min(options)[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _spines(self, plain, parts, rank, made, side: int) -> tuple[np.ndarray, np.ndarray]:
        chains = {}
        for p in made:
            chain, up, at = [], [], p
            above = np.inf
            while True:
                chain.append(plain[at])
                up.append(above)
                if at not in parts:
                    break
                above, at = rank[at], parts[at][side]
            chains[plain[p]] = chain, up
        depth = max(len(c) for c, _ in chains.values())
        ids = np.full((len(self.bytes), depth), -1, dtype=np.int32)
        ups = np.full((len(self.bytes), depth), -np.inf)
        for i, (chain, up) in chains.items():
            ids[i, : len(chain)], ups[i, : len(chain)] = chain, up
        return ids, ups

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge joins across the border of pieces ``a`` and ``b``."""
        fine = np.ones(len(a), dtype=bool)
        for i in range(self.right.shape[1]):
            for j in range(self.left.shape[1]):
                x, y = self.right[a, i], self.left[b, j]
                up_x, up_y = self.right_up[a, i], self.left_up[b, j]
                both = np.flatnonzero(fine & (x >= 0) & (y >= 0))
                if not len(both):
                    continue
                x, y, up_x, up_y = x[both], y[both], up_x[both], up_y[both]
                formed = np.maximum(self.rank[x], self.rank[y])
                now = (formed < up_x) & (formed <= up_y)
                both, x, y, up_x, up_y, formed = (v[now] for v in (both, x, y, up_x, up_y, formed))
                key = x.astype(np.int64) * self.size + y
                at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                known = self.pair[at] == key
                own = self.rank[self.joined[at]]
                when = np.maximum(own, formed)
                wins = known & (when < up_x) & ((when < up_y) | (own == up_y))
                fine[both[wins]] = False
        return fine


def _keys(table: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that sort alike."""
    wide = np.ascontiguousarray(table.astype(">u2"))
    return wide.view(f"S{2 * table.shape[1]}").ravel()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Stretches:
    """Pieces of the stretches that were encoded before, by their hashes."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def new(self, keys: np.ndarray) -> np.ndarray:
        """Which of some sorted, distinct hashes are not known. What is known is forgotten if it has grown too large."""
        if len(self.keys) > KEPT_STRETCHES or len(self.ids) > KEPT_PIECES:
            self.forget()
        if not len(self.keys):
            return np.ones(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def add(self, keys: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, cuts[:-1] + len(self.ids))
        self.size = np.insert(self.size, at, np.diff(cuts))
        self.ids = np.concatenate([self.ids, ids])


class _Borders:
    """Answers of ``may_follow`` that were asked before, and stretches that were encoded before."""

    def __init__(self, words: Vocabulary) -> None:
        self.words = words
        self.stretches = _Stretches()
        self.keys = np.zeros(0, dtype=np.int64)
        self.fine = np.zeros(0, dtype=bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key, back = np.unique(a.astype(np.int64) * self.words.size + b, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        if not known.all():
            new = key[~known]
            fine = self.words.may_follow(new // self.words.size, new % self.words.size)
            self.keys, self.fine = np.insert(self.keys, at[~known], new), np.insert(self.fine, at[~known], fine)
            at = np.searchsorted(self.keys, key)
        return self.fine[at][back]


def _edges(words: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece) of every occurrence of every piece; code 0 matches nothing."""
    n, width = len(codes), words.width
    padded = np.zeros(n + width, dtype=np.uint16)
    padded[:n] = codes
    suffixes = _keys(np.lib.stride_tricks.sliding_window_view(padded, width)[:n])
    order = np.argsort(suffixes, kind="stable").astype(np.int32)
    ranked = suffixes[order]
    del suffixes, padded
    low = np.searchsorted(ranked, words.low, side="left")
    count = np.maximum(np.searchsorted(ranked, words.high, side="right") - low, 0)
    before = np.cumsum(count) - count
    places = np.arange(int(count.sum()), dtype=np.int32) + np.repeat((low - before).astype(np.int32), count)
    return order[places], np.repeat(words.piece_len, count), np.repeat(words.piece_ids, count)


def _encode_stretches(words: Vocabulary, borders: _Borders, points: np.ndarray, first: np.ndarray):
    """Pieces of stretches given as code points with the ``first`` point of each: (ids, offsets)."""
    n = len(points)
    codes = words.code[points]
    space, unknown = codes == words.code[ord(SPACE)], codes == 0
    cut = space.copy()
    cut[first[:-1]] = True
    cut |= unknown
    cut[1:] |= unknown[:-1]
    begin = np.flatnonzero(cut)
    segment = np.cumsum(cut) - 1
    # One text, a 0 between segments so that no piece crosses.
    layout = np.zeros(n + len(begin), dtype=np.uint16)
    where = np.arange(n) + segment
    layout[where] = codes
    start, length, piece = _edges(words, layout)
    origin = (begin + np.arange(len(begin))).astype(np.int32)
    owner = np.cumsum(np.bincount(origin, minlength=len(layout)).astype(np.int32)) - 1
    local_end = start + length - origin[owner[start]]
    # Small numbers sort by their digits, in linear time.
    small = np.uint16 if not len(local_end) or local_end.max() < 1 << 16 else np.int64
    order = np.argsort(local_end.astype(small), kind="stable")
    start, length, piece, local_end = start[order], length[order], piece[order], local_end[order]
    last = np.full(len(layout) + 1, -1, dtype=np.int32)  # the piece that ends at a position
    cuts = np.searchsorted(local_end, np.arange(1, int(local_end[-1]) + 2 if len(local_end) else 1))
    for k in range(len(cuts) - 1):
        s, m, p = (v[cuts[k] : cuts[k + 1]] for v in (start, length, piece))
        fine = m == k + 1
        later = np.flatnonzero(~fine)
        if len(later):
            fine[later] = borders(last[s[later]], p[later])
        last[(s + m)[fine]] = p[fine]
    # Back from the end of each segment.
    stop = np.append(begin[1:], n) - begin + origin
    at, who = stop.copy(), np.arange(len(begin))
    live = ~unknown[begin]
    at, who = at[live], who[live]
    ids, whose, step = [], [], []
    turn = 0
    while len(at):
        p = last[at]
        ids.append(p)
        whose.append(who)
        step.append(np.full(len(p), -turn))
        at = at - words.length[p]
        more = at > origin[who]
        at, who, turn = at[more], who[more], turn + 1
    if unknown.any():  # byte pieces
        odd = np.flatnonzero(unknown)
        raw = points[odd].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for place, char in zip(segment[odd].tolist(), raw, strict=True):
            own = np.frombuffer(char.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            ids.append(words.byte_id[own])
            whose.append(np.full(len(own), place))
            step.append(np.arange(len(own)))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
    ids, whose, step = np.concatenate(ids), np.concatenate(whose), np.concatenate(step)
    order = np.lexsort((step, whose))
    ids, whose = ids[order], whose[order]
    stretch = np.searchsorted(first, begin, side="right") - 1
    per = np.bincount(stretch[whose], minlength=len(first) - 1)
    offsets = np.append(0, np.cumsum(per))
    return _join_spaces(words, ids, offsets)


def _join_spaces(words: Vocabulary, ids: np.ndarray, offsets: np.ndarray):
    """Pieces for runs of spaces: from the left, as long as the vocabulary has them."""
    lone = ids == words.space
    twice = np.flatnonzero(lone[1:] & lone[:-1])
    if not len(twice) or len(words.runs) == 1:
        return ids, offsets
    longest = max(words.runs)
    hit = np.unique(np.searchsorted(offsets, twice, side="right") - 1)
    parts, sizes = [], np.diff(offsets)
    last = 0
    for k in hit.tolist():
        own, out, run = ids[offsets[k] : offsets[k + 1]].tolist(), [], 0
        for p in [*own, -1]:
            if p == words.space:
                run += 1
                continue
            while run:
                size = max(m for m in words.runs if m <= min(run, longest))
                out.append(words.runs[size])
                run -= size
            if p >= 0:
                out.append(p)
        parts += [ids[last : offsets[k]], np.array(out, dtype=ids.dtype)]
        last = offsets[k + 1]
        sizes[k] = len(out)
    parts.append(ids[last:])
    return np.concatenate(parts), np.append(0, np.cumsum(sizes))


def _encode_new(words: Vocabulary, borders: _Borders, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Pieces of stretches given as ranges of bytes: (ids, offsets)."""
    raw = data.tobytes()
    text = b"".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    # Code points before each stretch: bytes that do not continue a character.
    lead_byte = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    count = np.append(0, np.cumsum(lead_byte))
    return _encode_stretches(words, borders, points, count[np.append(0, np.cumsum(ends - starts))])


def encode_batch(words: Vocabulary, borders: _Borders, texts: pa.Array):
    """(first row, ids, offsets by row) of runs of texts whose spaces are plain and that start with one."""
    for first, data, offsets in text_runs(texts, INDEX_BYTES):
        found = Words(data, offsets, INSIDE)
        # A stretch runs from the end of one word to the end of the next; a tail may follow.
        rows = len(offsets) - 1
        ends = np.unique(np.concatenate([found.end, offsets[1:]]))
        ends = ends[ends > 0]
        if not len(ends):
            yield first, np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
            continue
        starts = np.append(0, ends[:-1])
        hashes = found.slices(starts, ends)
        keys, lead, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = borders.stretches
        new = known.new(keys)
        if new.any():
            lead = lead[new]
            known.add(keys[new], *_encode_new(words, borders, data, starts[lead], ends[lead]))
        at = np.searchsorted(known.keys, keys)
        take = known.size[at][back]
        before = np.cumsum(take) - take
        flat = known.ids[np.arange(int(take.sum())) + np.repeat(known.start[at][back] - before, take)]
        ending = np.searchsorted(ends, offsets, side="right")
        yield first, flat, np.append(0, np.cumsum(take))[ending]


def decode(words: Vocabulary, ids: list[int]) -> str:
    """The text of pieces, without the space that encoding puts first."""
    raw = b"".join([words.bytes[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " and words.bytes[ids[0]][:1] == b" " else raw).decode("utf-8", "replace")


def _ready(text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" ")))).otherwise(text)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, ids, n_pieces, same) for every row; ``same`` tells whether decoding gives the text back.

    U+2581 counts as a space there. A null text has null ids and null ``same``.
    """
    spark = docs.sparkSession
    send_code(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        words = shared.value
        borders = _BORDERS.setdefault(id(words), _Borders(words))
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts, n = part.column(1), part.num_rows
                ids, sizes, same = [], np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
                for first, flat, offsets in encode_batch(words, borders, texts):
                    ids.append(flat)
                    rows = len(offsets) - 1
                    sizes[first : first + rows] = np.diff(offsets)
                    plain, cuts = flat.tolist(), offsets.tolist()
                    own = texts.slice(first, rows).to_pylist()
                    for k, text in enumerate(own):
                        back = decode(words, plain[cuts[k] : cuts[k + 1]]) if text else ""
                        same[first + k] = back == (text or "")[1:]
                null = texts.is_null().to_numpy(zero_copy_only=False)
                offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                columns = [part.column(0), lists, pa.array(sizes), pa.array(same, mask=null)]
                yield pa.record_batch(columns, names=["key", "ids", "n_pieces", "same"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), _ready(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, n_pieces long, same boolean")


_BORDERS: dict[int, _Borders] = {}


def decode_ids(rows: DataFrame, path: str, id_col: str = "key", ids_col: str = "ids") -> DataFrame:
    """(key, text) of rows of piece ids; null stays null."""
    spark = rows.sparkSession
    send_code(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else decode(shared.value, ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"key {kind}, text string")
