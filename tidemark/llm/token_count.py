"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word, and dynamic programming carries nothing but
the best score and the number of pieces of the best segmentation at each place. Scores add from left to right in
double precision, and of equal scores the piece that starts first wins, as in the `tokenizers` library's unigram
model, whose counts these are: white-space prefix on each space-separated part, unknown characters at the lowest
score less ten, counted as their bytes where the vocabulary has byte pieces, as one piece a run where it has not.

The vocabulary at hand is a BPE model, whose scores are negative merge ranks. `fitted` gives its pieces unigram log
probabilities: counts of its own segmentation of all documents' words first, then of the best paths, in turns. While
fitting, the pieces themselves are wanted and not just how many, so there the library's model finds the paths.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, table, written
from tidemark.llm.registry import query

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_NEVER = float("-inf")
#: Distinct words a worker keeps the counts of; past it the older half stays, where the frequent words are.
KNOWN_WORDS = 1_000_000
#: Passes over the distinct words after the first, and what is added to each piece's count.
FIT_PASSES, ADDED = 2, 0.1


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in order of ids; the unknown piece is the first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    """Pieces of texts under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one part, by the best path that ends at each place.

        The automaton gives matches by their end, longest first, so of equal scores the piece that starts first is kept.
        """
        n = len(text)
        if self.singles.issuperset(text):  # each place is reached by known pieces
            score, count = [0.0] + [_NEVER] * n, [0] * (n + 1)
            for end, (length, s) in self.automaton.iter(text):
                end += 1
                here = s + score[end - length]
                if here > score[end]:
                    score[end], count[end] = here, count[end - length] + 1
            return count[n], score[n]
        score, count, in_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best: list[float | None] = [None] * (n + 1)
        closed = 0  # places up to here have their best path

        def close(upto: int) -> None:
            for end in range(closed + 1, upto + 1):
                here = best[end]
                last = text[end - 1]
                if last not in self.singles:
                    unknown = self.unknown + score[end - 1]
                    if here is None or unknown > here:
                        here, in_run[end] = unknown, True
                        if self.bytes:
                            count[end] = count[end - 1] + len(last.encode("utf-8", "surrogatepass"))
                        else:
                            count[end] = count[end - 1] + (not in_run[end - 1])
                score[end] = here

        for end, (length, s) in self.automaton.iter(text):
            end += 1
            if closed < end - 1:
                close(end - 1)
                closed = end - 1
            here = s + score[end - length]
            if best[end] is None or here > best[end]:
                best[end], count[end] = here, count[end - length] + 1
        close(n)
        return count[n], score[n]

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not isinstance(text, str) or not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        parts = (text[1:] if text[0] == " " else text).split(" ")
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) > KNOWN_WORDS:
                self.known = dict(islice(self.known.items(), KNOWN_WORDS // 2))
                found = list(map(self.known.get, parts))
            for i, f in enumerate(found):
                if f is None:
                    part = parts[i]
                    f = self.known.get(part)
                    if f is None:
                        f = self.known[part] = self.word(MARK + part)
                    found[i] = f
        counts, scores = zip(*found)
        return sum(counts), sum(scores)


@lru_cache(1)
def piece_counter(path: str) -> PieceCounter:
    """One per worker process, so later tasks find the words of earlier ones."""
    return PieceCounter(vocabulary(path))


@lru_cache(1)
def _fitted_counter(pieces: tuple[tuple[str, float], ...]) -> PieceCounter:
    return PieceCounter(list(pieces))


def _path_finder(pieces: tuple[tuple[str, float], ...]):
    """The known pieces on the best path of a word, by the `tokenizers` unigram model of these scores."""
    from tokenizers.models import Unigram

    model, unknown = Unigram(list(pieces), 0, False), pieces[0][0]

    def cut(word: str) -> list[str]:
        return [t.value for t in model.tokenize(MARK + word) if t.id or t.value == unknown]

    return cut


def fitted(docs: DataFrame, model_path: str | None = None, passes: int = FIT_PASSES) -> tuple[tuple[str, float], ...]:
    """The model's pieces with log probabilities from all documents.

    Spark counts the distinct words once; each pass segments these and adds up their pieces. The driver sees one
    count for each piece of the vocabulary. Without documents all pieces are equally likely.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    names = [p for p, _ in vocabulary(path)]
    text = F.regexp_replace(F.translate("text", MARK, " "), "^ ", "")
    words = docs.where("text IS NOT NULL AND text <> ''").select(F.explode(F.split(text, " ", -1)).alias("word"))
    words = written(words.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    pieces = None
    for _ in range(passes + 1):
        def run(frames, pieces=pieces) -> Iterator[pd.DataFrame]:
            if pieces is None:
                import sentencepiece

                cut = sentencepiece.SentencePieceProcessor(model_file=path).encode_as_pieces
            else:
                cut = _path_finder(pieces)
            total: Counter[str] = Counter()
            for frame in frames:
                for w, n in zip(frame["word"], frame["n"].tolist()):
                    for p in cut(w):
                        total[p] += n
            yield pd.DataFrame({"piece": list(total), "n": list(total.values())}).astype({"piece": object, "n": "int64"})

        found = words.mapInPandas(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = {r["piece"]: r["n"] for r in found.collect()}
        total = math.log(sum(counts.get(p, 0) + ADDED for p in names))
        pieces = tuple((p, math.log(counts.get(p, 0) + ADDED) - total) for p in names)
    dropped(words)
    return pieces


def token_counts(
    docs: DataFrame, model_path: str | None = None, pieces: tuple[tuple[str, float], ...] | None = None
) -> DataFrame:
    """doc_id, n_pieces, score per document, in one pass without a shuffle.

    pieces: (piece, log probability) in place of the model's own scores, as `fitted` gives them.
    Null and empty texts have no pieces and score 0. Repeated rows each give a row; other columns are ignored.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(frames) -> Iterator[pd.DataFrame]:
        count = piece_counter(path) if pieces is None else _fitted_counter(pieces)
        for frame in frames:
            found = [count(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "n_pieces": [f[0] for f in found], "score": [f[1] for f in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_pieces long, score double")


@query("op9_token_count")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, pieces=fitted(docs))
