"""SentencePiece encoding with N-best segmentations, and decoding.

A text is a lattice: nodes between characters, an edge for each vocabulary piece that spans two nodes,
weighted by the piece's score. Forward Viterbi gives the best score from the start to every node; those
scores are the exact heuristic of an A* search that walks back from the end, so segmentations leave its
queue in order of their score.

No piece continues past a word mark that is not at its start, so the lattice falls into one lattice per
word, and best paths are found once for each distinct word of a slice of texts: the forward pass and the
way back run over all those words at a time, by place in the word. The N best of a whole text differ from its best one in few words: a second-best path of a word costs that word's smallest
detour (known from the forward pass), and only the words with the N - 1 smallest detours can be part of
the N best. The search runs on those.
"""

from __future__ import annotations

import heapq
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import send_by_value

MARK = "▁"             # stands for a space
UNKNOWN_PENALTY = 10.0      # a character outside the vocabulary scores this much below the worst piece
SLICE_CHARS = 1 << 17       # texts that are handled at once; a longer text is handled alone
SHORT = 64                  # longer words are solved one by one


@dataclass
class Vocabulary:
    """Pieces and scores of a model file."""

    scores: dict[str, tuple[int, float]]    # piece -> (id, score)
    prefixes: set[str]                      # every proper prefix of a piece
    pieces: list[str]
    bytes_from: int | None                  # id of <0x00>, of 256 consecutive ones; None if the model has no byte pieces
    unknown: int
    floor: float
    whole_lines: bool                       # no piece contains a line feed
    trie: "Trie | None" = None              # made when first asked for

    def __post_init__(self):
        # Every piece and every prefix of one: its score, or None for what is a prefix only.
        self.table = {p: None for p in self.prefixes} | {p: s for p, (_, s) in self.scores.items()}
        self.spelling = [p.replace(MARK, " ").encode("utf-8") for p in self.pieces]
        if self.bytes_from is not None:
            self.spelling[self.bytes_from:self.bytes_from + 256] = [bytes([b]) for b in range(256)]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = {}
        for i, piece in enumerate(pieces):
            # Word marks after other characters would join two words; runs of marks alone are allowed.
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} spans two words")
                plain[piece] = (i, float(model.get_score(i)))
        # Runs of marks carry a score that is a sentinel; the floor is of pieces with other characters.
        floor = min((s for p, (_, s) in plain.items() if p.strip(MARK)), default=0.0)
        return cls(plain, {p[:j] for p in plain for j in range(1, len(p))}, pieces, next((i for i in range(n) if model.is_byte(i)), None),
                   model.unk_id(), floor, not any("\n" in p for p in plain))


_NO_PREFIX = object()


def edges(v: Vocabulary, word: str) -> list[list[tuple[int, str | None, float]]]:
    """For each node, the edges that end there: (node they come from, piece or None, score). A
    character that no piece covers alone gets an edge of its own, spelled in bytes."""
    n = len(word)
    into: list[list[tuple[int, str | None, float]]] = [[] for _ in range(n + 1)]
    scores, prefixes, fallback = v.scores, v.prefixes, v.floor - UNKNOWN_PENALTY
    for i in range(n):
        j = i + 1
        piece = word[i:j]
        if piece not in scores:
            into[j].append((i, None, fallback))
        while True:
            if piece in scores:
                into[j].append((i, piece, scores[piece][1]))
            if piece not in prefixes or j == n:
                break
            j += 1
            piece = word[i:j]
    return into


def _spelled(v: Vocabulary, char: str) -> list[int]:
    return [v.bytes_from + b for b in char.encode("utf-8")] if v.bytes_from is not None else [v.unknown]


def _ids(v: Vocabulary, path: list[str | None], word: str, cuts: list[int]) -> list[int]:
    out: list[int] = []
    for piece, at in zip(path, cuts):
        out.extend([v.scores[piece][0]] if piece is not None else _spelled(v, word[at]))
    return out


def viterbi(v: Vocabulary, word: str) -> tuple[float, list[int], float]:
    """(best score, its ids, smallest detour: how much the second best segmentation is worse, or
    infinity). Of equal scores the longer last piece wins, at every node."""
    n, table, fallback, low = len(word), v.table, v.floor - UNKNOWN_PENALTY, float("-inf")
    best, second, back = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        base, j = best[i], i + 1
        score = table.get(word[i:j], _NO_PREFIX)
        if score is None or score is _NO_PREFIX:
            total = base + fallback
            if total > best[j]:
                second[j], best[j], back[j] = best[j], total, i
            elif total > second[j]:
                second[j] = total
        while score is not _NO_PREFIX:
            if score is not None:
                total = base + score
                if total > best[j]:
                    second[j], best[j], back[j] = best[j], total, i
                elif total > second[j]:
                    second[j] = total
            j += 1
            if j > n:
                break
            score = table.get(word[i:j], _NO_PREFIX)
    at, ids, detour = n, [], float("inf")
    while at:
        detour = min(detour, best[at] - second[at])
        start = back[at]
        known = v.scores.get(word[start:at])
        ids.extend((known[0],) if known else reversed(_spelled(v, word[start])))
        at = start
    ids.reverse()
    return best[n], ids, detour


def n_best(v: Vocabulary, word: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations, best first, by A* from the end of the word."""
    into = edges(v, word)
    best = [0.0] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        best[j] = max(best[i] + s for i, _, s in into[j])
    # (loss against the best path, node, tie order, score of the rest, rest). The best edge into a node
    # loses exactly 0 and of equal losses the node nearest the start is taken, so whatever is taken
    # reaches the start in as many steps as it has pieces, however many paths tie with it. The first to
    # arrive is the path of `viterbi`, as that too prefers the longer piece at every node.
    queue = [(0.0, len(word), 0, 0.0, None)]
    found, order = [], -1
    while queue and len(found) < n:
        lost, at, _, rest, path = heapq.heappop(queue)
        if at == 0:
            pieces, cuts = [], []
            while path is not None:
                (start, piece), path = path
                pieces.append(piece)
                cuts.append(start)
            found.append((rest, _ids(v, pieces, word, cuts)))
            continue
        for i, piece, score in into[at]:
            heapq.heappush(queue, (lost + (best[at] - (best[i] + score)), i, order, rest + score, ((i, piece), path)))
            order -= 1
    return found


_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_WORDS_OPEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def split_words(v: Vocabulary, text: str) -> list[str | None]:
    """Words of a text with marks for spaces, a mark before the first as the model expects. None
    stands for a word mark in the text itself, which is spelled in bytes so that it decodes to itself."""
    pattern, words = _WORDS if v.whole_lines else _WORDS_OPEN, []
    for k, part in enumerate(text.split(MARK)) if text else ():
        if k:
            words.append(None)
        words += pattern.findall((MARK if k == 0 else "") + part.replace(" ", MARK))
    return words


class Trie:
    """All prefixes of pieces as nodes, their children in a hash table of arrays."""

    def __init__(self, v: Vocabulary):
        names = sorted(v.table, key=len)
        number = {"": 0} | {name: i + 1 for i, name in enumerate(names)}
        keys = np.array([number[name[:-1]] << 21 | ord(name[-1]) for name in names], np.uint64)
        known = [v.scores.get(name, (-1, np.nan)) for name in names]
        self.piece = np.array([-1] + [p for p, _ in known], np.int64)
        self.score = np.array([np.nan] + [s for _, s in known])
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.child = np.full(1 << bits, -1, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):        # the first to come takes a slot, the others try the next one
            _, first = np.unique(at, return_index=True)
            first = first[self.child[at[first]] < 0]
            self.keys[at[first]], self.child[at[first]] = keys[left[first]], left[first] + 1
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Children by a character, -1 where there is none."""
        keys = (nodes.astype(np.uint64) << np.uint64(21)) | chars.astype(np.uint64)
        at = self._slot(keys)
        found, held = self.child[at], self.keys[at]
        left = np.flatnonzero((held != keys) & (found >= 0))
        found[held != keys] = -1
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]] = self.child[at[left[hit]]]
            left = left[~hit & (self.child[at[left]] >= 0)]
        return found


def viterbi_all(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`viterbi` of many non-empty words: (ids end to end, where each word's begin and the last end, best
    scores, smallest detours). Edges are taken by place of their start, then by length, for all words at
    a time, so sums and ties are those of the single form."""
    v.trie = v.trie or Trie(v)
    lengths = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    begins = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(chars)) - begins[word]
    left = lengths[word] - place
    edges_at: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []     # (start, length, piece, score)
    active, nodes, length = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
    while len(active):
        nodes = v.trie.step(nodes, chars[active + length])
        length += 1
        piece, score = np.where(nodes < 0, -1, v.trie.piece[nodes]), v.trie.score[nodes]
        if length == 1:     # a character that is no piece has an edge of its own
            score = np.where(piece < 0, v.floor - UNKNOWN_PENALTY, score)
            edges_at.append((active, length, piece, score))
        else:
            is_piece = piece >= 0
            edges_at.append((active[is_piece], length, piece[is_piece], score[is_piece]))
        on = (nodes >= 0) & (left[active] > length)
        active, nodes = active[on], nodes[on]
    start = np.concatenate([e[0] for e in edges_at])
    span = np.concatenate([np.full(len(e[0]), e[1]) for e in edges_at])
    piece, score = np.concatenate([e[2] for e in edges_at]), np.concatenate([e[3] for e in edges_at])
    turn = place[start] * (length + 1) + span
    if len(turn) and turn.max() < 1 << 16:
        turn = turn.astype(np.uint16)       # sorted by radix
    order = np.argsort(turn, kind="stable")
    start, span, piece, score, turn = start[order], span[order], piece[order], score[order], turn[order]
    # Nodes of a word lie one more than its characters, so each word's are shifted by the words before.
    tail = start + word[start]
    nodes_of = len(chars) + len(words)
    best, second, back = np.full(nodes_of, -np.inf), np.full(nodes_of, -np.inf), np.full(nodes_of, -1, np.int64)
    heads = begins + np.arange(len(words))
    best[heads] = 0.0
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1, [len(turn)]]).tolist()
    for low, high in zip(cuts, cuts[1:]):
        head = tail[low:high] + span[low]
        total, old = best[tail[low:high]] + score[low:high], best[head]
        better = total > old
        second[head] = np.where(better, old, np.maximum(second[head], total))
        best[head] = np.where(better, total, old)
        back[head] = np.where(better, np.arange(low, high), back[head])
    ends = heads + lengths
    scores = best[ends].copy()
    detours, steps = np.full(len(words), np.inf), []
    at, walking = ends.copy(), np.arange(len(words))
    while len(walking):
        detours[walking] = np.minimum(detours[walking], best[at] - second[at])
        edge = back[at]
        steps.append((walking, edge))
        at = at - span[edge]
        on = at > heads[walking]
        at, walking = at[on], walking[on]
    # A word's edges come last one first: put each where it belongs.
    pieces = np.zeros(len(words), np.int64)
    for walked, _ in steps:
        pieces[walked] += 1
    after = np.cumsum(pieces)
    edge = np.empty(int(pieces.sum()), np.int64)
    for k, (walked, taken) in enumerate(steps):
        edge[after[walked] - 1 - k] = taken
    of = np.repeat(np.arange(len(words)), pieces)
    ids, bare = piece[edge], piece[edge] < 0
    if v.bytes_from is None:
        counts = np.ones(len(ids), np.int64)
        out = np.where(bare, v.unknown, ids)
    else:
        code = chars[start[edge]]
        counts = np.where(bare, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        out = np.repeat(ids, counts)
        spelled = np.ascontiguousarray(code[bare], "<u4").tobytes().decode("utf-32-le").encode("utf-8")
        out[np.repeat(bare, counts)] = v.bytes_from + np.frombuffer(spelled, np.uint8).astype(np.int64)
    sizes = np.bincount(of, weights=counts, minlength=len(words)).astype(np.int64)
    return out.astype("<i4"), np.concatenate([[0], np.cumsum(sizes)]), scores, detours


def _smallest(values, k: int) -> list[int]:
    """Places of the k smallest finite values in order of place; of equal ones the first."""
    array = np.asarray(values, float)
    if k < 1 or not len(array):
        return []
    limit = np.partition(array, k - 1)[k - 1] if len(array) > k else np.inf
    less, equal = np.flatnonzero(array < limit), np.flatnonzero(array == limit)
    picked = np.sort(np.r_[less, equal[:k - len(less)]]) if np.isfinite(limit) else less
    return picked.tolist()


def _solve(v: Vocabulary, words: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`viterbi_all` of distinct words, among them long ones and the bare mark (None)."""
    short = [k for k, w in enumerate(words) if w is not None and len(w) <= SHORT]
    ids, bounds, some_scores, some_detours = viterbi_all(v, [words[k] for k in short]) if short else (np.zeros(0, "<i4"), np.zeros(1, np.int64), [], [])
    if len(short) == len(words):
        return ids, bounds, some_scores, some_detours
    parts: list = [None] * len(words)
    scores, detours = np.zeros(len(words)), np.zeros(len(words))
    scores[short], detours[short] = some_scores, some_detours
    for place, k in enumerate(short):
        parts[k] = ids[bounds[place]:bounds[place + 1]]
    for k, word in enumerate(words):
        if parts[k] is None:
            scores[k], own, detours[k] = (viterbi(v, word) if word is not None
                                          else (v.floor - UNKNOWN_PENALTY, _spelled(v, MARK), float("inf")))
            parts[k] = np.array(own, "<i4")
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), scores, detours


def encode_texts(v: Vocabulary, texts: list[str], n: int) -> list[tuple[bytes, int, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
    """For each text (ids as packed int32, their number, best score, alternatives). An alternative is its
    score and the edits that turn the best ids into it: (first id, ids replaced, new ids)."""
    number: dict[str | None, int] = {}
    places = [np.array([number.setdefault(w, len(number)) for w in split_words(v, text)], np.int64) for text in texts]
    words = list(number)
    if not words:
        return [(b"", 0, 0.0, []) for _ in texts]
    ids, bounds, scores, detours = _solve(v, words)
    sizes = np.diff(bounds)
    searched: dict[int, list[tuple[float, list[int]]]] = {}
    out = []
    for at in places:
        lengths = sizes[at]
        starts = np.cumsum(lengths) - lengths
        packed = ids[np.repeat(bounds[at] - starts, lengths) + np.arange(int(lengths.sum()))].tobytes()
        total = float(scores[at].sum())
        options: list[tuple[float, list[tuple[int, list[int]]]]] = [(0.0, [])]   # (loss, changed words)
        for word in _smallest(detours[at], n - 1):
            own = searched.get(at[word])
            if own is None:
                own = searched[at[word]] = n_best(v, words[at[word]], n)
            spread = [(loss, change) if k == 0 else (loss + own[0][0] - score, [*change, (word, new)])
                      for loss, change in options for k, (score, new) in enumerate(own)]
            options = heapq.nsmallest(n, spread, key=lambda o: o[0])
        alternatives = [(total - loss, [(int(starts[w]), int(lengths[w]), new) for w, new in change]) for loss, change in options[1:]]
        out.append((packed, int(lengths.sum()), total, alternatives))
    return out


def encode_text(v: Vocabulary, text: str, n: int) -> tuple[bytes, int, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
    return encode_texts(v, [text], n)[0]


def decode_ids(v: Vocabulary, ids) -> str:
    """The text of a list of ids: pieces and byte pieces joined as UTF-8, marks turned into spaces, the
    mark before the first word dropped."""
    text = b"".join(map(v.spelling.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_OUT = ("pieces binary, n_pieces long, score double, "
        "alternatives array<struct<score:double,edits:array<struct<at:int,replaced:int,ids:array<int>>>>>")
_ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct(
    [("at", pa.int32()), ("replaced", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def _encode_rows(path: str, n: int):
    def run(batches):
        v = Vocabulary.load(path)
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("text"))
            ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0), np.int64))
            first = 0
            while first < len(ids):
                done = ends[first - 1] if first else 0
                size = max(1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")) - first)
                rows = encode_texts(v, [t or "" for t in texts.slice(first, size).to_pylist()], n)
                alternatives = [[{"score": s, "edits": [{"at": a, "replaced": r, "ids": i} for a, r, i in e]} for s, e in row[3]] for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, size), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.float64()), pa.array(alternatives, _ALTERNATIVES)],
                    ["id", "pieces", "n_pieces", "score", "alternatives"])
                first += size
    return run


def encode(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, pieces (ids, packed little-endian int32), n_pieces, score and the
    n - 1 next best segmentations as edits of the best.

    The model file must be readable at `model_path` on every worker. Null and empty texts have no
    pieces and score 0. Equal scores are ordered by the search, the same way on every run. A lattice
    with fewer than n paths gives all of them. Other columns are not read.
    """
    if n < 1:
        raise ValueError("n must be positive")
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return held.mapInArrow(_encode_rows(model_path, n), f"id {held.schema['id'].dataType.simpleString()}, {_OUT}").withColumnRenamed("id", id_col)


def _decode_rows(path: str, names: list[str]):
    def run(batches):
        v = Vocabulary.load(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                raws = part.column(part.schema.get_field_index("_pieces")).to_pylist()
                texts = [decode_ids(v, np.frombuffer(raw or b"", "<i4").tolist()) for raw in raws]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(texts, pa.string())],
                                                 [*names, "_text"])
    return run


def decode(encoded: DataFrame, model_path: str, keep: list[str], pieces_col: str = "pieces", into: str = "text") -> DataFrame:
    """Columns `keep` and the text of the packed ids; null ids give the empty text."""
    held = encoded.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(pieces_col).alias("_pieces"))
    names = [f"c{i}" for i in range(len(keep))]
    kinds = "".join(f"{c} {held.schema[c].dataType.simpleString()}, " for c in names)
    out = held.mapInArrow(_decode_rows(model_path, names), kinds + "_text string")
    return out.select(*[F.col(c).alias(k) for c, k in zip(names, keep)], F.col("_text").alias(into))


send_by_value(sys.modules[__name__])
