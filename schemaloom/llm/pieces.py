"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

Vocabulary and scores come from a SentencePiece model file; nothing is trained. A segmentation is a path through the lattice of
pieces, its score the sum of its pieces' scores. A forward Viterbi pass gives every place its best score, which is then
the exact heuristic of a backward A* search: paths leave the search complete and in order of score.

A text is cut only between two signs that stand side by side in no piece, so its lattice falls into segments (words with
the signs that pieces join to them) that are solved once per distinct segment, for many at a time. Of each segment the loss of its second-best path is known too; the N best paths of a text leave
the best one in none but the N - 1 segments of least loss, and only there the search has to run.

Encoding is reversible for every text: a character without a piece of its own becomes its UTF-8 bytes, and so does
the sign that stands for a blank.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _BASE, _INVERSE, _power, mix

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
BEST = 3
CACHED_WORDS = 100_000
STEP_WORDS = 20_000
#: Places of a segment whose edges a search keeps in memory.
KEPT_PLACES = 4_096
_SLOTS = 22


def _hashes(points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(points)), out=total[1:])
    return total


class Pieces:
    """A vocabulary: pieces with scores, and the ids of single bytes."""

    def __init__(self, model_file: str = MODEL_FILE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.piece = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = np.array([model.get_score(i) for i in range(size)])
        self.fallback = float(self.score[list(self.piece.values())].min()) - 10
        self.longest = max(map(len, self.piece))
        self.text = [b""] * size
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        for p, i in self.piece.items():
            self.text[i] = p.replace(BLANK, " ").encode()
        within = lambda x: any(re.search(x, p) for p in self.piece)
        marks = "".join(c for c in string.punctuation if not within(f"[^\\W_]{re.escape(c)}"))
        cut = re.escape(marks)
        before: dict[str, set[str]] = {}  # of each mark: the signs other than marks that some piece has before it
        for p in self.piece:
            for a, b in itertools.pairwise(p):
                if b in marks and a not in marks and a != BLANK:
                    before.setdefault(b, set()).add(a)
        like: dict[frozenset[str], str] = {}
        for mark, signs in sorted(before.items()):
            like[frozenset(signs)] = like.get(frozenset(signs), "") + mark
        joined = "|".join(f"(?<=[{re.escape(''.join(sorted(signs)))}])[{re.escape(own)}]" for signs, own in like.items())
        joined = f"(?:(?=[{cut}])(?:{joined})[{cut}]*[^ \n{cut}]*)*" if before else ""
        words = f" *(?:[^ \n{cut}]+|[{cut}]+[^ \n{cut}]*){joined}| +|\n" if marks else " *[^ \n]+| +|\n"
        self.segment = re.compile("(?s).+" if within(f"[^{BLANK}]{BLANK}|\n") else words)
        if any(len(self.segment.findall(p.replace(BLANK, " "))) != 1 for p in self.piece):
            raise ValueError("the split cuts a piece")
        names = list(self.piece)
        hashes = []
        for p in names:
            points = np.array([ord(c) for c in p], np.uint32)
            hashes.append(mix(_hashes(points)[-1:])[0])
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.array(hashes, np.uint64)[order]
        self.ids = np.array([self.piece[p] for p in names])[order]
        # two tables of slots: pieces that share a slot of the first are in the second, none share both
        high, low = self._slots(self.hashes)
        self.slots = np.full((2, 1 << _SLOTS), -1, np.int32)
        alone = np.bincount(high, minlength=1 << _SLOTS)[high] == 1
        self.slots[0][high[alone]] = np.flatnonzero(alone)
        rest = np.flatnonzero(~alone)
        self.slots[1][low[rest]] = rest
        if len(np.unique(low[rest])) < len(rest):
            raise ValueError("two pieces share both slots")
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.searched: dict[str, tuple[int, list[tuple[float, tuple[int, ...]]]]] = {}

    @staticmethod
    def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64), (hashes & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)

    # one segment at a time, for the search

    def ending(self, segment: str, signs: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the pieces that end at a place. segment: blanks as blanks; signs: as pieces have them."""
        found = []
        for start in range(max(0, end - self.longest), end):
            if (i := self.piece.get(signs[start:end])) is not None:
                found.append((start, float(self.score[i]), (i,)))
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, self.fallback, tuple(self.byte[b] for b in segment[end - 1].encode("utf-8", "surrogatepass"))))
        return found

    def search(self, segments: list[str], best: int = BEST) -> list[tuple[float, list[tuple[int, ...]]]]:
        """The best segmentations of segments in a row: (score, ids of each segment), by score from the best.

        Of equal losses the place nearest to the start goes first, so the search follows one path to its end before it tries
        an equal one; and no place is left more than best times, as the best paths through it need no more. Both keep the number of
        steps in proportion to the length, also where all paths are equally good. Of paths with equal scores those stay that were met first.
        """
        at = [0, *itertools.accumulate(map(len, segments))]
        signs = [x.replace(BLANK, "\0").replace(" ", BLANK) for x in segments]

        def into(place: int) -> list[tuple[int, float, tuple[int, ...]]]:
            k = bisect.bisect_left(at, place) - 1
            return [(at[k] + s, w, ids) for s, w, ids in self.ending(segments[k], signs[k], place - at[k])]

        if at[-1] <= KEPT_PLACES:  # edges of longer segments are looked up again, not kept
            into = [(), *(self.ending(segments[0], signs[0], place) if place <= at[1] else into(place) for place in range(1, at[-1] + 1))].__getitem__
        forward = [0.0]
        for place in range(1, at[-1] + 1):
            forward.append(max(forward[s] + w for s, w, _ in into(place)))
        found, tie, left = [], itertools.count(), [0] * len(forward)
        # (loss against the best path, place, tie, score after place, pieces after place)
        heap = [(-forward[-1], at[-1], next(tie), 0.0, None)]
        while heap and len(found) < best:
            _, place, _, score, tail = heapq.heappop(heap)
            if not place:
                parts: list[list[int]] = [[] for _ in segments]
                while tail:
                    end, ids, tail = tail
                    parts[bisect.bisect_left(at, end) - 1] += ids
                found.append((score, [tuple(p) for p in parts]))
                continue
            left[place] += 1
            if left[place] > best:
                continue
            for start, w, ids in into(place):
                heapq.heappush(heap, (-(forward[start] + score + w), start, next(tie), score + w, (place, ids, tail)))
        return found

    def _searched(self, segment: str, best: int) -> list[tuple[float, tuple[int, ...]]]:
        if segment not in self.searched or len(self.searched[segment][1]) < best > self.searched[segment][0]:
            self.searched[segment] = (best, [(s, x[0]) for s, x in self.search([segment], best)])
        return self.searched[segment][1][:best]

    # many segments at a time

    def _solve(self, words: list[str]) -> None:
        """Puts (ids as int32 bytes, score, loss of the second-best path) of each word into known; words of like lengths."""
        signs = "".join(words).replace(BLANK, "\0").replace(" ", BLANK)
        points = np.frombuffer(signs.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        total, inverse = _hashes(points), _power(_INVERSE, len(points))
        left = at[1:].repeat(np.diff(at)) - np.arange(len(points))  # signs up to the word's end
        starts, lengths, ids = [], [], []
        place = np.arange(len(points))
        single = np.zeros(len(points), bool)
        for length in range(1, min(self.longest, int(left.max())) + 1):
            place = place[left[place] >= length]
            h = mix((total[place + length] - total[place]) * inverse[place])
            high, low = self._slots(h)
            k = self.slots[0][high]
            k = np.where(k < 0, self.slots[1][low], k)
            hit = np.flatnonzero((k >= 0) & (self.hashes[k] == h))
            starts.append(place[hit])
            lengths.append(np.full(len(hit), length))
            ids.append(self.ids[k[hit]])
            if length == 1:
                single[starts[0]] = True
        lone = np.flatnonzero(~single)
        starts, lengths, ids = (np.concatenate(x[::-1]) for x in ([*starts, lone], [*lengths, np.ones(len(lone), int)], [*ids, np.full(len(lone), -1)]))
        weight = np.where(ids >= 0, self.score[ids], self.fallback)
        word = np.repeat(np.arange(len(words)), np.diff(at))[starts]
        # places of word k are at[k] + k ... at[k + 1] + k: one more than signs
        p = starts + word
        q = p + lengths
        rank = starts - at[word]
        depth = rank + lengths
        small = np.int16 if int(left.max()) < 30_000 else np.int64
        first = at[:-1] + np.arange(len(words))
        last = at[1:] + np.arange(len(words))
        forward = np.full(len(points) + len(words), -np.inf)
        forward[first] = 0
        chosen = np.full(len(forward), -1)
        order = np.argsort(depth.astype(small), kind="stable")[::-1]  # of equals the longest piece comes last
        for e in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[::-1]:
            reach = forward[p[e]] + weight[e]
            np.maximum.at(forward, q[e], reach)
            top = e[reach == forward[q[e]]]
            chosen[q[top]] = top
        backward = np.full(len(forward), -np.inf)
        backward[last] = 0
        order = np.argsort(rank.astype(small), kind="stable")
        for e in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1)[::-1]:
            np.maximum.at(backward, p[e], backward[q[e]] + weight[e])
        on_best = np.zeros(len(p), bool)
        place, path = last.copy(), []
        alive = np.flatnonzero(place > first)
        while len(alive):
            e = chosen[place[alive]]
            on_best[e] = True
            path.append(e)
            place[alive] = p[e]
            alive = alive[place[alive] > first[alive]]
        path = np.concatenate(path)
        path = path[np.argsort(p[path])]
        other = np.flatnonzero(~on_best)
        second = np.full(len(words), -np.inf)
        np.maximum.at(second, word[other], forward[p[other]] + weight[other] + backward[q[other]])
        score = forward[last]
        loss = score - second
        path_ids, path_word = ids[path].astype(np.int32), word[path]
        cuts = np.searchsorted(path_word, np.arange(len(words) + 1))
        plain = np.ones(len(words), bool)
        plain[path_word[path_ids < 0]] = False
        flat = path_ids.tobytes()
        for k, w in enumerate(words):
            own = flat[4 * cuts[k] : 4 * cuts[k + 1]]
            if not plain[k]:
                full = []
                for e in path[cuts[k] : cuts[k + 1]]:
                    c = w[p[e] - first[k]]
                    full += [ids[e]] if ids[e] >= 0 else [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
                own = np.array(full, np.int32).tobytes()
            self.known[w] = (own, float(score[k]), float(loss[k]))

    def solve(self, words: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w).bit_length(), []).append(w)
        for size, own in by_size.items():
            own.sort()
            step = max(1, (STEP_WORDS * 8) >> size)
            for k in range(0, len(own), step):
                self._solve(own[k : k + step])

    def encode(self, texts: list[str], best: int = BEST) -> Iterator[tuple[np.ndarray, list[float], list[list[tuple[int, tuple[int, ...]]]]]]:
        """Of each text: ids of the best segmentation, scores of the best ones, and of each of these where it differs: (segment, ids)."""
        split = self.segment.findall
        for k in range(0, len(texts), 200):
            segments = [split(" " + x) if x else [] for x in texts[k : k + 200]]
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
                self.searched.clear()
            new = set().union(*segments).difference(self.known)
            if new:
                self.solve(new)
            for own in segments:
                solved = [self.known[s] for s in own]
                ids = np.frombuffer(b"".join([x[0] for x in solved]), np.int32)
                score = sum(x[1] for x in solved)
                losses = np.array([x[2] for x in solved])
                least = np.sort(np.argsort(losses, kind="stable")[: best - 1])
                least = [int(i) for i in least if losses[i] < np.inf]
                if not least:
                    yield ids, [score], [[]]
                    continue
                found = [(score, [])]
                for i in least:  # sums of the best of each, and of these the best
                    top = solved[i][1]
                    usual = tuple(np.frombuffer(solved[i][0], np.int32).tolist())
                    found = [(s + own_score - top, away + [(i, x)] * (x != usual)) for s, away in found for own_score, x in self._searched(own[i], best)]
                    found = sorted(found, key=lambda x: -x[0])[:best]
                yield ids, [s for s, _ in found], [away for _, away in found]

    def decode(self, ids: list[int]) -> str:
        table = self.text
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


_loaded: dict[str, Pieces] = {}


def pieces(model_file: str = MODEL_FILE) -> Pieces:
    """The vocabulary, loaded once per process."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces(os.path.realpath(model_file))
    return _loaded[model_file]


def encoded(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """(doc_id, piece_ids array<int>) of every row of docs (doc_id, text); other columns are ignored.

    Null and empty texts have no pieces. Texts are encoded whole, however long; of equally good segmentations the one with the longest last pieces is taken. Repeated rows and rows without
    an id have a result each; an empty table gives an empty one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_file)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = [ids for ids, _, _ in vocabulary.encode([x or "" for x in part.column("text").to_pylist()], 1)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(at, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "piece_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, piece_ids array<int>")


def decoded(rows: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """(doc_id, text) of rows with doc_id and piece_ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_file)
        for batch in batches:
            texts = [vocabulary.decode(x or []) for x in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "piece_ids").mapInArrow(each, "doc_id long, text string")


_SCHEMA = "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, scores array<double>, alternatives_sha256 string"


def segmentations(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """Digest of every row of docs (doc_id, text): number of pieces, SHA-256 of the best segmentation's ids (decimal, comma-joined)
    and of the text decoded from them, the scores of the BEST best segmentations and a SHA-256 of where the others differ.

    Null and empty texts have no pieces, one score of 0, and decode to the empty text. Repeated rows give equal rows. A text
    with fewer segmentations has fewer scores; of equal scores the segmentation with the longest last pieces comes first. Texts are read whole, however long; other
    columns are ignored. An empty table gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_file)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for ids, scores, away in vocabulary.encode([x or "" for x in batch.column("text").to_pylist()]):
                own = ids.tolist()
                out.append((len(own), sha(",".join(map(str, own))), sha(vocabulary.decode(own)), scores, sha(repr(away[1:]))))
            columns = [list(x) for x in zip(*out, strict=True)] if out else [[]] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, _SCHEMA)
