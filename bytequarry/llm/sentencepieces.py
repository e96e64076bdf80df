"""Operator 4: SentencePiece encoding and decoding by n-best segmentation.

A text is a lattice of pieces. Forward Viterbi scores, the best score from the start to each position, are exact
estimates of what is still missing when segmentations are built backwards from the end; a best-first (A-star) search
with them meets complete segmentations from the best downwards and opens no path that leads nowhere. No piece reaches
over two neighbouring characters that stand together in no piece, so the lattice falls apart at such places: each
distinct part is searched once, and a text's n best segmentations are the n best sums over its parts.

Scores: a unigram model's own; a BPE model has merge ranks instead of probabilities, which are taken as Zipf's law has
them, log p = -log rank - log sum(1/rank). So a BPE model's best segmentation here is its most probable one, not
necessarily the one that its merges give.
"""

from __future__ import annotations

import math
import struct
import zlib
from bisect import insort
from operator import concat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Index, kept, spread, texts_of, trim, use_workers

SPACE = "▁"
#: Below a model's least probable piece: what a character outside the pieces costs, as the library has it.
UNKNOWN = 10.0
#: Scores are multiples of one in so many: sums of them are exact in double precision, up to 5e8.
GRAIN = 1 << 24
#: Distinct words that a worker remembers, of LETTERS characters each on average; of parts of words it remembers two sets
#: of a third of that, none longer than LONG.
REMEMBERED, LETTERS, LONG = 700_000, 24, 200


def merged(lists: list[list[float]], n: int) -> list[float]:
    """The n smallest sums with one number of each (ascending) list."""
    out = [0.0]
    for x in lists:
        out = sorted(a + b for a in out for b in x[:n])[:n]
    return out


class Pieces:
    """A model's lattice and its segmentations; made once in each Python worker."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in plain}
        if all(s == int(s) and s <= 0 for s in score.values()):  # ranks of merges
            total = math.log(sum(1 / (1 + k) for k in range(len(plain))))
            order = sorted(plain, key=lambda i: (-score[i] if score[i] > -1e8 else 1e9, i))
            score = {i: -math.log(1 + k) - total for k, i in enumerate(order)}
        score = {i: round(s * GRAIN) / GRAIN for i, s in score.items()}  # so that sums are exact, and equal ones equal
        self.pieces = {sp.id_to_piece(i): (i, score[i]) for i in plain}
        self.ends: dict = {}  # pieces by their letters from the last to the first: (letters before, piece or None)
        for p, found in self.pieces.items():
            node = self.ends
            for k in range(len(p) - 1, -1, -1):
                deeper, piece = node.get(p[k]) or ({}, None)
                node[p[k]] = (deeper, found if k == 0 else piece)
                node = deeper
        self.together = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        seconds = {t[1] for t in self.together}
        self.alone = {c for c in ".,;:!?" if c not in seconds}  # marks that always begin a part
        self.by_word = not any(t[1] == SPACE and t[0] != SPACE for t in self.together)
        self.unknown = min(score.values()) - UNKNOWN
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.as_bytes = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        first = sp.normalize("a")
        self.prefix = first.startswith(SPACE)
        self.plain = all(sp.normalize(x) == SPACE * self.prefix + x.replace(" ", SPACE) for x in ("  a  b ", "ﬁ Å\té\n①", " x　"))
        self.known: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}
        self.lists: dict[tuple, list[float]] = {}
        self.last: tuple = ("", [])
        self.forget()

    @classmethod
    def at(cls, path: str, remembered: int = REMEMBERED) -> Pieces:
        return kept("Pieces", path, remembered, make=lambda: cls(path, remembered))

    def normalized(self, text: str) -> str:
        """The text as the library normalizes it, spaces as U+2581."""
        if not text:
            return ""
        return SPACE * self.prefix + text.replace(" ", SPACE) if self.plain else self.library.normalize(text)

    def parts(self, text: str) -> list[str]:
        """The text cut wherever two neighbours stand together in no piece."""
        together = self.together
        if together.issuperset(map(concat, text, text[1:])):
            return [text]
        if len(text) > 1 and text[-1] in self.alone and text[-2] not in self.alone:
            return [*self.parts(text[:-1]), text[-1]]
        out, at = [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in together:
                out.append(text[at:i])
                at = i
        out.append(text[at:])
        return out

    def ending(self, part: str, at: int) -> list[tuple[int, int | tuple, float]]:
        """(start, id or ids, score) of the pieces that end at a position, the shortest first; a character that is no piece has one too."""
        out, node, i = [], self.ends, at
        while i:
            node = node.get(part[i - 1])
            if node is None:
                break
            i -= 1
            node, piece = node
            if piece:
                out.append((i, *piece))
        if not out or out[0][0] < at - 1:
            out.insert(0, (at - 1, self.outside(part[at - 1]), self.unknown))
        return out

    def forward(self, part: str) -> list[float]:
        """Best score from the start to each position (Viterbi). A long part is remembered till the next, as it comes
        several times in a row."""
        if part == self.last[0]:
            return self.last[1]
        best, tree, unknown, least = [0.0], self.ends, self.unknown, -math.inf
        for j in range(1, len(part) + 1):
            node, i, one, single = tree, j, least, False
            while i:
                node = node.get(part[i - 1])
                if node is None:
                    break
                i -= 1
                node, piece = node
                if piece:
                    value = best[i] + piece[1]
                    if value > one:
                        one = value
                    if i == j - 1:
                        single = True
            if not single and best[j - 1] + unknown > one:
                one = best[j - 1] + unknown
            best.append(one)
        if len(part) > LONG:
            self.last = part, best
        return best

    def outside(self, letter: str) -> tuple[int, ...]:
        """Ids of a character that no piece has: its bytes, or the unknown piece."""
        return tuple(self.bytes[b] for b in letter.encode("utf-8", "surrogatepass")) if self.bytes else (self.unk,)

    def segmentations(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a part, best first: backward A-star over the lattice.

        An open end of a segmentation, from a position to the part's end, has as its estimate the score of the best
        segmentation that ends so, which the forward scores tell exactly. Scores are exact sums (see __init__), so the
        best open end goes on at an equal estimate until it meets the start, however many tie with it; no two ends share
        a segmentation, so no more of them need to wait than segmentations are asked for.
        """
        best, edges = self.forward(part), self.ending
        queue, out, turn = [], [], 0  # the queue: ends that wait, best first
        total, at, own, path = best[-1], len(part), 0.0, None
        while True:
            room, bar = n - 1 - len(out), queue[-1][0] if queue and len(queue) == n - 1 - len(out) else math.inf
            while at:
                on = None
                for start, ids, score in edges(part, at):
                    score += own
                    value = best[start] + score
                    if value == total and on is None:
                        on = start, score, (ids, path)
                        continue
                    if -value < bar and room:
                        turn += 1
                        insort(queue, (-value, turn, start, score, (ids, path)))
                        if len(queue) > room:
                            queue.pop()
                        if len(queue) == room:
                            bar = queue[-1][0]
                at, own, path = on
            ids = []
            while path:
                ids += path[0] if path[0].__class__ is tuple else (path[0],)
                path = path[1]
            out.append((total, ids))
            if not queue or len(out) == n:
                return out
            total, _, at, own, path = queue.pop(0)
            total = -total

    def _part(self, part: str) -> tuple[bytes, float, float]:
        """(ids as bytes, score, how much worse the second best is) of a part: the same search for two, of which only one
        end waits; its estimate is exact, so the second segmentation needn't be opened to know its score."""
        best, edges = self.forward(part), self.ending
        at, total, own, bar, ids = len(part), best[-1], 0.0, -math.inf, []
        while at:
            on = None
            for edge in edges(part, at):
                value = best[edge[0]] + (own + edge[2])
                if value > bar:
                    if value == total and on is None:
                        on = edge
                    else:
                        bar = value
                elif value == total and on is None:
                    on = edge
            at, piece, score = on
            own += score
            ids.append(piece)
        if tuple in map(type, ids):
            ids = [x for i in ids for x in ((i,) if i.__class__ is int else i[::-1])]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids), total, total - bar

    def part(self, part: str) -> tuple[bytes, float, float]:
        """The same, remembered."""
        found = self.known.get(part)
        if found is None:
            found = self.before.get(part) or self._part(part)
            if len(self.known) > self.remembered // 3:
                self.before, self.known = self.known, {}
            if len(part) <= LONG:
                self.known[part] = found
        return found

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text (n small): for each its score and ids."""
        out = [(0.0, [])]
        for part in self.parts(self.normalized(text)) if text else []:
            own = self.segmentations(part, n)
            out = sorted(((a[0] + b[0], a[1] + b[1]) for a in out for b in own), key=lambda x: -x[0])[:n]
        return out

    # Texts word by word: distinct words have their best ids, their score and the loss of their second best.
    def forget(self) -> None:
        self.index = Index()
        self.ids: list[bytes] = []
        self.values = np.zeros((0, 2))
        self.held = 0
        trim()

    def learn(self) -> None:
        """Ids, score and loss of the words that are new in the index."""
        known, prefix, made = self.known.get, SPACE, []
        for word in self.index.new:
            self.held += len(word) if word.__class__ is str else len(word[0])
            parts = self.parts(prefix + word if word.__class__ is str else word[0])
            found = known(parts[0]) or self.part(parts[0])
            if len(parts) == 1:
                self.ids.append(found[0])
                made.append(found[1:])
                continue
            ids, score, loss = [found[0]], found[1], found[2]
            for p in parts[1:]:
                found = known(p) or self.part(p)
                ids.append(found[0])
                score += found[1]
                if found[2] < loss:
                    loss = found[2]
            self.ids.append(b"".join(ids))
            made.append((score, loss))
        n = len(self.ids)
        if n > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((n, 2))])
        self.values[n - len(made) : n] = made
        self.index.new.clear()

    def losses(self, word: str | tuple[str], n: int) -> list[float]:
        """How much worse than its best the n best segmentations of a word are."""
        out = self.lists.get((word, n))
        if out is None:
            lists, spelt = [], self.spelt(word)
            for part in self.parts(spelt):
                if self.part(part)[2] < math.inf:
                    found = self.segmentations(part, n)
                    lists.append([found[0][0] - f[0] for f in found])
            out = merged(lists, n)
            if len(self.lists) >= 20_000:
                self.lists.clear()
            if len(spelt) <= LONG:
                self.lists[word, n] = out
        return out

    def words(self, text: str) -> list[str | tuple[str]]:
        """A text cut at its single spaces, each word standing for a space and itself; or, where spaces stand together or
        begin it, or it needs the library's normalization, its parts, as tuples of one."""
        if not text:
            return []
        if self.by_word and self.plain and self.prefix and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [(p,) for p in self.parts(self.normalized(text))]

    @staticmethod
    def spelt(word: str | tuple[str]) -> str:
        return SPACE + word if isinstance(word, str) else word[0]

    def encode(self, texts: list[str], n: int) -> list[tuple[bytes, list[float]]]:
        """(ids of the best segmentation as little-endian unsigned 32-bit integers, scores of the n best) of whole texts."""
        words = [self.words(t) for t in texts]
        at = [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in words]
        if len(self.index) > len(self.ids):
            self.learn()
        out = []
        for own, w in zip(at, words, strict=True):
            score, loss = float(self.values[own, 0].sum()), self.values[own, 1]
            some = np.argpartition(loss, n - 2)[: n - 1] if len(loss) > n - 1 > 0 else np.arange(len(loss) if n > 1 else 0)
            near = merged([self.losses(w[i], n) for i in some.tolist() if loss[i] < math.inf], n)
            out.append((b"".join(map(self.ids.__getitem__, own.tolist())), [score - x for x in near]))
        if len(self.index) > self.remembered or self.held > LETTERS * self.remembered:
            self.forget()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; a byte sequence that is no UTF-8 gives U+FFFD."""
        raw = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def segmented(docs: DataFrame, model: str, n_best: int = 4, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False, remembered: int = REMEMBERED, with_library: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, scores, decoded_equal[, ids][, library_ids]) for each row.

    ids: best segmentation (array of int); ids_crc32: of the ids as little-endian unsigned 32-bit integers; scores:
    those of the n_best best segmentations, best first, fewer if there are no more; decoded_equal: decoding the ids
    gives the normalized text back; library_ids: the library's own ids, for a BPE model those of its merges. model: path of a SentencePiece model, readable on every worker. Null text counts as
    empty (no pieces, one segmentation of score 0); remembered: words that a worker keeps (some 0.5 KB each); null ids
    stay null; repeated rows give repeated results; an empty table an empty result. Of equally good segmentations the
    one whose last pieces are shorter comes first.
    """
    use_workers(docs.sparkSession)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, decoded_equal boolean" + ", ids array<int>" * with_ids + ", library_ids array<int>" * with_library

    step = 200 if remembered > 100_000 else 64  # texts at a time

    def encode(batches):
        pieces = Pieces.at(model, remembered)
        for batch in batches:
            ids, texts = batch.column("doc_id"), texts_of(batch)
            for i in range(0, len(texts), step):
                part = texts[i : i + step]
                made = pieces.encode(part, n_best)
                normal = lambda x: x.replace(SPACE, " ") if pieces.plain else (pieces.normalized(x)[pieces.prefix :]).replace(SPACE, " ")
                columns = {
                    "doc_id": ids.slice(i, len(part)),
                    "n_pieces": pa.array([len(b) // 4 for b, _ in made], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(b) for b, _ in made], pa.int64()),
                    "scores": pa.array([s for _, s in made], pa.list_(pa.float64())),
                    "decoded_equal": pa.array([pieces.decode(b) == normal(x) for x, (b, _) in zip(part, made, strict=True)], pa.bool_()),
                }
                if with_ids:
                    flat = np.frombuffer(b"".join(b for b, _ in made), "<i4")
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(b) // 4 for b, _ in made)]), pa.int32()), pa.array(flat, pa.int32()))
                if with_library:
                    columns["library_ids"] = pa.array(pieces.library.encode(part, num_threads=1), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(encode, schema)


def decoded(table: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The table's columns and `text`, decoded from its column of ids; null ids give null."""
    use_workers(table.sparkSession)
    schema = table.withColumn("text", F.lit("").cast("string")).schema

    def decode(batches):
        pieces = Pieces.at(model)
        for b in batches:
            t = pa.array([None if x is None else pieces.decode(np.array(x, "<u4").tobytes()) for x in b.column(ids).to_pylist()], pa.string())
            named = {**dict(zip(b.schema.names, b.columns, strict=True)), "text": t}
            yield pa.RecordBatch.from_arrays([named[c] for c in schema.names], schema.names)

    return table.mapInArrow(decode, schema)
