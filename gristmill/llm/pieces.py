"""N-best segmentations of whole texts over the piece lattice of a SentencePiece model, and decoding.

Every run of characters that is a piece is an arc with the piece's score; a character that no piece holds is an arc of
its UTF-8 byte pieces. A forward Viterbi pass gives the best score from the start to every place. Searched backward from the
end, that score is the exact rest of the way: an A* search pops complete segmentations in the order of their scores and
never opens a way that isn't part of one of them.

A text is cut where no piece can reach across, so that its n-best list follows from those of its parts: the least losses of
the parts, added up. The forward pass gives what each part's second choice loses, too, so that the backward search runs only for
the few parts of a text that lose least. Parts recur, and what is known of them is remembered within a bound.

Scores are those of the model file, whatever they are. A unigram model holds log-probabilities; the file that the query
uses (``piece_bpe_32k.model``) is a BPE model whose scores are its merge ranks, negated, so its best segmentation here is the one
of the least sum of ranks, which as a rule is not the one that the library's own merging gives. Normalisation is that of a
model that only turns blanks into their sign and puts one before the text, as this one does.
"""

from __future__ import annotations

import gc
import operator
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NEVER, NEVER_REACHED = float("inf"), -1e300
REACHED = operator.itemgetter(0)
#: Stands behind the last character of a part; no piece holds it.
END = "\0\0"
#: A character that begins no piece; and characters of a part that is searched as a whole even where it could be cut further.
NOTHING, UNCUT = ({}, 0.0, None), 16
#: Marks that begin a part of their own wherever that is safe.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LATTICES: dict[tuple, Lattice] = {}


class Lattice:
    """Pieces of a model, and n-best segmentations of texts by them."""

    def __init__(self, path: str, n_best: int = 3, max_parts: int = 400_000):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usable}
        self.ids = {piece: struct.pack("<I", model.piece_to_id(piece)) for piece in self.score}
        self.bytes = [struct.pack("<I", model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.unknown = min((s for s in self.score.values() if s > -1e8), default=0.0) - 10
        # pieces with their score and ids; beginnings of pieces that aren't pieces themselves with an empty entry
        self.table: dict[str, tuple] = {p[:k]: () for p in self.score for k in range(1, len(p))}
        self.table |= {p: (s, self.ids[p]) for p, s in self.score.items()}
        self.longest = max(map(len, self.score))
        # the same as a tree: a character leads to the characters that may follow it, and the score and ids of the piece that ends with it, if any
        self.heads: dict[str, tuple] = {}
        for prefix in sorted(self.table, key=len):
            after = self.heads
            for char in prefix[:-1]:
                after = after[char][0]
            after[prefix[-1]] = ({}, *(self.table[prefix] or (0.0, None)))
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() for i, p in enumerate(map(model.id_to_piece, range(size)))]
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.n_best, self.max_parts = n_best, max_parts
        self.known: dict[str, tuple] = {}
        self.parts = self._cutter()

    def _cutter(self) -> re.Pattern:
        """Parts end before blanks, around white space and before marks, but never within a pair that a piece holds."""
        bare = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not any(chr(c) in pair for pair in self.inside))
        firsts: dict[str, str] = {}
        for one, two in self.inside:
            firsts[two] = firsts.get(two, "") + one
        after = lambda char: f"(?<=[{re.escape(firsts[char])}])" if char in firsts else "(?!)"  # noqa: E731  where ``char`` can't be cut off
        out = re.escape(BLANK + bare)
        run = f"[^{out}{re.escape(MARKS)}]*"
        joined = "|".join(f"{re.escape(m)}(?<=[{re.escape(firsts[m])}].)" for m in MARKS if m in firsts)
        word = f"[^{out}]{run}" + (f"(?:(?:{joined}){run})*" if joined else "")
        space = f"|[{re.escape(bare)}]" if bare else ""
        return re.compile(f"{BLANK}*{word}(?:{after(BLANK)}{BLANK}+(?:{word})?)*|{BLANK}+{space}")

    def normal(self, text: str) -> str:
        """``text`` as the model sees it: a blank before it, and blanks as their sign."""
        return BLANK + text.replace(" ", BLANK) if text else ""

    def forward(self, part: str) -> tuple[float, bytes, float]:
        """The best score of ``part`` (Viterbi), its ids, and what the second best loses; ``NEVER`` if there is none."""
        n, heads, longest = len(part), self.heads, self.longest
        best, second, back = [0.0] + [NEVER_REACHED] * n, [NEVER_REACHED] * (n + 1), [None] * (n + 1)
        for i, char in enumerate(part):
            here, next_, j = best[i], second[i], i + 1
            after, score, ids = heads.get(char, NOTHING)
            if ids is None:
                score, ids = self._bytes(char)
            for char in part[j : i + longest] + END:
                if ids is not None:
                    reached, was = here + score, best[j]
                    if reached > was:
                        other = next_ + score
                        best[j], back[j] = reached, (i, ids)
                        second[j] = was if was > other else other
                    elif reached > second[j]:
                        second[j] = reached
                node = after.get(char)
                if node is None:
                    break
                j += 1
                after, score, ids = node
        made, at = [], n
        while at:
            at, ids = back[at]
            made.append(ids)
        made.reverse()
        loss = best[n] - second[n]
        return best[n], b"".join(made), loss if loss < -NEVER_REACHED / 2 else NEVER

    def search(self, part: str) -> list[tuple[float, bytes]]:
        """The ``n_best`` segmentations of ``part`` by score; equal scores in the order in which the search meets them."""
        n, heads, longest = len(part), self.heads, self.longest
        ends: list[list] = [[] for _ in range(n + 1)]  # arcs by the place where they end: (best score up to there by it, start, score, ids)
        best = [0.0] + [NEVER_REACHED] * n
        for i, char in enumerate(part):  # one arc for each piece that begins here
            here, j = best[i], i + 1
            after, score, ids = heads.get(char, NOTHING)
            if ids is None:
                score, ids = self._bytes(char)
            reached = here + score
            ends[j].append((reached, i, score, ids))
            if reached > best[j]:
                best[j] = reached
            for char in part[j : i + longest]:
                node = after.get(char)
                if node is None:
                    break
                j += 1
                after, score, ids = node
                if ids is not None:
                    reached = here + score
                    ends[j].append((reached, i, score, ids))
                    if reached > best[j]:
                        best[j] = reached
        # every open way is worth exactly the best whole segmentation that ends in it, so no more need be open than are wanted
        left, tick, found, way = self.n_best, 0, [], (best[n], 0, n, 0.0, None)
        ways: list[tuple] = []  # the others, the best last
        while left:
            _, _, at, behind, done = way
            if at:
                arcs = ends[at]
                if len(arcs) == 1 and not ways:  # the only way on
                    _, i, score, ids = arcs[0]
                    way = (0.0, 0, i, score + behind, (ids, done))
                    continue
                if len(arcs) > left:
                    arcs.sort(key=REACHED)
                    arcs = arcs[-left:]
                for reached, i, score, ids in arcs:
                    tick -= 1
                    ways.append((reached + behind, tick, i, score + behind, (ids, done)))
                if len(ways) > 1:
                    ways.sort()
                    if len(ways) > left:
                        del ways[:-left]
            else:
                ids = []
                while done:
                    one, done = done
                    ids.append(one)
                found.append((behind, b"".join(ids)))
                left -= 1
            if not ways:
                break
            way = ways.pop()
        return found

    def _bytes(self, char: str) -> tuple[float, bytes]:
        raw = char.encode("utf-8", "surrogatepass")
        return self.unknown * len(raw), b"".join(self.bytes[b] for b in raw)

    def join(self, lists: list[tuple]) -> list[tuple[float, bytes]]:
        """N-best list of a whole whose parts have these; only the parts that lose least by their second choice can differ."""
        scores, first, losses, _ = zip(*lists, strict=True)
        total, whole = sum(scores), b"".join(first)
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        open_: list[float] | tuple[float, ...] = losses
        for _ in range(self.n_best - 1):
            least = min(open_)
            if least == NEVER:
                break
            k = open_.index(least)
            open_ = [*open_[:k], NEVER, *open_[k + 1 :]]
            top, choices = scores[k], lists[k][3]
            if type(choices) is str:  # only here is the list of a part needed
                choices = self.search(choices)
            ways = sorted([(loss + top - s, (*picked, (k, ids))) for loss, picked in ways for s, ids in choices], key=REACHED)[: self.n_best]
        out = []
        for loss, picked in ways:
            made = whole
            for k, ids in sorted(picked, reverse=True):  # the last part first, so that the places of the others hold
                if ids != first[k]:
                    at = sum(map(len, first[:k]))
                    made = made[:at] + ids + made[at + len(first[k]) :]
            out.append((total - loss, made))
        return out

    def part(self, text: str) -> tuple:
        """(best score, its ids, what the second choice loses, n-best list or the text to search for it) of a part of a text; a long one is cut further where no piece reaches across."""
        if (known := self.known.get(text)) is None:
            cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.inside] if len(text) > UNCUT else ()
            if not cuts:
                known = (*self.forward(text), text)
            else:
                found = self.join([self.part(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
                known = (found[0][0], found[0][1], found[0][0] - found[1][0] if len(found) > 1 else NEVER, tuple(found))
            if len(self.known) > self.max_parts:
                self.known.clear()
            self.known[text] = known
        return known

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """(score, ids as little-endian u32) of the n best segmentations, best first; one empty one for an empty text."""
        if not text:
            return [(0.0, b"")]
        parts = self.parts.findall(self.normal(text))
        found = list(map(self.known.get, parts))
        return self.join([one or self.part(part) for one, part in zip(found, parts, strict=True)] if None in found else found)

    def encode_all(self, texts: list[str | None]) -> list[list[tuple[float, bytes]]]:
        """:meth:`encode` of each text. Nothing here makes a cycle, so garbage collection rests meanwhile."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return [self.encode(t) for t in texts]
        finally:
            if resting:
                gc.enable()

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation; byte pieces that aren't UTF-8 come out as replacement characters."""
        whole = b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace").replace(BLANK, " ")
        return whole.removeprefix(" ")


def lattice(path: str, n_best: int) -> Lattice:
    """The worker's own lattice of this model; loaded once a process."""
    if (path, n_best) not in _LATTICES:
        _LATTICES[path, n_best] = Lattice(path, n_best)
        gc.freeze()  # the tree lives as long as the worker: garbage collection needn't look at it again and again
    return _LATTICES[path, n_best]


def encode_nbest(docs: DataFrame, model: str, *, n_best: int = 3) -> DataFrame:
    """``doc_id`` and ``segmentations``: array of (score, n_pieces, ids), best first, of every whole text of ``docs``.

    ids: little-endian unsigned 32-bit integers. Null and empty texts have one empty segmentation; a text may have fewer
    than ``n_best``. Texts of any length are taken whole; equal scores stand in the order in which the search meets them. Repeated rows get equal results; other columns aren't read; an empty table stays empty. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, n_best)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids", pa.binary())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [[{"score": s, "n_pieces": len(i) // 4, "ids": i} for s, i in one] for one in own.encode_all(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, kind)], ["doc_id", "segmentations"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, segmentations array<struct<score: double, n_pieces: long, ids: binary>>")


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and the ``text`` of its column of ids (an existing ``text`` goes); null stays null."""
    kept = encoded.drop("text")
    at, schema = kept.columns.index(ids), kept.withColumn("text", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, 1)
        for batch in batches:
            texts = pa.array([None if x is None else own.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], schema=pa.schema([*batch.schema, ("text", pa.string())]))

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, *, n_best: int = 3) -> DataFrame:
    """As :func:`encode_nbest`, with the ids of each segmentation as their crc32, and whether the best one decodes to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, n_best)
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = own.encode_all(texts)
            back = [own.decode(f[0][1]) == (t or "").replace(BLANK, " ") for f, t in zip(found, texts, strict=True)]
            columns = [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([[s for s, _ in f] for f in found], doubles)]
            columns += [pa.array([[len(i) // 4 for _, i in f] for f in found], longs), pa.array([[zlib.crc32(i) for _, i in f] for f in found], longs), pa.array(back, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_best", "scores", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_best long, scores array<double>, n_pieces array<long>, ids_crc32 array<long>, round_trip boolean")
