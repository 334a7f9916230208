"""Token counts with the whole-token shortcut, for sentence-piece BPE vocabularies with byte fallback.

Offline, every string of the vocabulary is run through the merges: those that come out as themselves are *whole*.
The text is cut where no merge can cross: before a run of spaces (no piece has a space mark after another
character) and around line feeds where the vocabulary has no piece with one. A pre-token that is whole counts 1;
only the rest is merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import MEMORY, BatchMerger, _Remembered

#: Fixed value: the character that stands for a space in the vocabulary.
MARK = "▁"
LIMIT = 4096


class PieceCounter:
    def __init__(self, path: str, memory: int = MEMORY):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        # Highest score first; ids settle equal scores as the library's order of equal agenda entries does not arise.
        usable = [i for i in range(loaded.vocab_size()) if not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_byte(i) or loaded.is_unused(i))]
        scores = {loaded.id_to_piece(i): loaded.get_score(i) for i in usable}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[s] for piece, s in scores.items()}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece has a space mark inside, so spaces don't part the merges")
        self.lines_part = not any("\n" in piece for piece in self.rank)
        self.bytes_known = any(loaded.is_byte(i) for i in range(loaded.vocab_size()))
        self.longest = max(map(len, self.rank), default=1)
        numbers = {piece: i for i, piece in enumerate(self.rank)}
        self.batch = BatchMerger([(numbers[p[:k]], numbers[p[k:]], self.rank[p], i) for p, i in numbers.items() for k in range(1, len(p)) if p[:k] in numbers and p[k:] in numbers])
        self.number = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in numbers.items():
            if len(piece) == 1:
                self.number[ord(piece)] = i
        self.whole = frozenset(piece for piece in self.rank if self.merged(piece) == 1)
        self.counts = _Remembered(self._count, memory)
        self.chunks = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def learn(self, pretokens: set[str]) -> None:
        """Count the pre-tokens that aren't remembered: whole ones as 1, the others merged side by side in arrays."""
        known, old, whole = self.counts, self.counts.old, self.whole
        lacking = []
        for p in pretokens:
            if len(p) <= 64 and p not in known and p not in old:
                if p in whole:
                    known.put(p, 1)
                elif len(p) <= BatchMerger.WIDTH:
                    lacking.append(p)
        if lacking:
            lengths = np.array([len(p) for p in lacking])
            symbols = self.number[np.frombuffer("".join(lacking).encode("utf-32-le"), dtype=np.uint32)]
            sure = np.minimum.reduceat(symbols, np.cumsum(lengths) - lengths) >= 0  # characters out of the vocabulary are left to the other path
            counts, _ = self.batch.merge(symbols, lengths)
            for p, n, ok in zip(lacking, counts.tolist(), sure.tolist()):
                if ok:
                    known.put(p, n)

    def _count(self, pretoken: str) -> int:
        return 1 if pretoken in self.whole else self.merged(pretoken)

    def merged(self, pretoken: str) -> int:
        """Tokens after merging; runs of unknown characters fall back to their bytes."""
        total, start = 0, 0
        known = [c in self.rank for c in pretoken]
        for i, ok in enumerate([*known, False]):
            if not ok:
                if i > start:
                    total += self._merge(pretoken[start:i])
                if i < len(pretoken):
                    total += len(pretoken[i].encode("utf-8")) if self.bytes_known else 1
                start = i + 1
        return total

    def _merge(self, run: str) -> int:
        if len(run) > 48:
            return self._merge_long(run)
        get, none = self.rank.get, 1 << 60
        parts = list(run)
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return len(parts)

    def _merge_long(self, run: str) -> int:
        from heapq import heapify, heappop, heappush

        n, get = len(run), self.rank.get
        parts, after, before = list(run), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, run[i : i + 2]) for i in range(n - 1) if (r := get(run[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, text = heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != text:
                continue
            parts[i], parts[j] = text, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n:
                    both = parts[left] + parts[right]
                    if len(both) <= self.longest and (r := get(both)) is not None:
                        heappush(heap, (r, left, both))
        return sum(1 for p in parts if p)

    def cut(self, text: str) -> list[str]:
        """Pre-tokens: no merge crosses from one to the next. A line feed is one of its own where the vocabulary lacks it."""
        marked = MARK + text.replace(" ", MARK)
        if self.lines_part and "\n" in marked:
            return [p for line in marked.split("\n") for p in ("\n", *self.chunks.findall(line))][1:]
        return self.chunks.findall(marked)

    def __call__(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.cut(text))) if text else 0

    def totals(self, texts: list[str]) -> list[int]:
        """The count of each text, with new pre-tokens learned a few million characters at a time."""
        out, at = [], 0
        while at < len(texts):
            cuts, size = [], 0
            for text in texts[at:]:
                cuts.append(self.cut(text) if text else [])
                if (size := size + len(text)) > 2_000_000:
                    break
            self.learn({p for p in set().union(*cuts) if p not in self.counts})
            out += [sum(map(self.counts.__getitem__, cut)) for cut in cuts]
            at += len(cuts)
        return out


_LOADED: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def count_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; a null text counts as empty. One pass, no shuffle.

    Repeated rows are counted as they come; an empty table gives none; other columns are left aside, so their names don't
    matter; very long texts are counted whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = piece_counter(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            tokens = count.totals(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of the documents; see count_documents for awkward rows."""
    import public_tokenizers

    from .common import table

    return count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
