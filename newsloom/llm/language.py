"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces of the products of their probabilities, found by the forward algorithm;
a text is its words. Probabilities come from expectation maximisation over all segmentations (forward-backward)
of a bounded sample of labelled texts. A prediction sees the text only.

Words are runs of letters, in lower case; runs of more than WORD_LETTERS letters are scored in stretches. A
letter that no piece holds is an unknown piece of its own.

Null texts and texts without letters are ``und`` with score 0, and so is everything if there is nothing to learn
from. Null labels teach nothing. Null ids and repeated rows are rows like others. Of equally likely languages the
first in code-point order is taken. Columns other than id, text and lang are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.spans import mix, powers
from newsloom.llm.tables import gathered, held_out, small_batches, stored

WORD_LETTERS = 31
PIECE_LETTERS = 10
START = "▁"  # how the vocabulary marks the beginning of a word
# Labelled texts per language that the model is fitted on (about, by a hash of the id), and rounds of fitting.
SAMPLE_TEXTS = 1500
ROUNDS = 2
SMOOTHING = 0.1
KNOWN_WORDS = 300_000  # words whose scores a worker remembers before it begins anew
LETTERS = regex.compile(r"\p{L}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str, longest: int = PIECE_LETTERS) -> list[str]:
    """The pieces made of letters, in lower case, with or without the mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        bare = piece.removeprefix(START)
        if len(piece) <= longest and (LETTERS.fullmatch(bare) or piece == START):
            found.add(piece)
    return sorted(found)


def words_in(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def stretches(word: str) -> list[str]:
    """A word with its mark, in parts short enough for plain doubles."""
    marked = START + word
    return [marked[i : i + WORD_LETTERS + 1] for i in range(0, len(marked), WORD_LETTERS + 1)]


class Lattice:
    """All pieces within many strings at once: ``at[j][k]`` has the piece of length k that ends at j."""

    def __init__(self, strings: list[str], keys: np.ndarray, longest: int):
        self.order = np.argsort([-len(s) for s in strings], kind="stable")
        ordered = [strings[i] for i in self.order]
        self.length = np.array([len(s) for s in ordered], dtype=np.int64)
        points = np.frombuffer("".join(ordered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        prefix, down = prefix_of(points)
        unknown = len(keys)
        self.at: list[list[np.ndarray]] = [[]]
        for j in range(1, int(self.length.max(initial=0)) + 1):
            alive = int(np.searchsorted(-self.length, -j, side="right"))
            pieces = []
            for k in range(1, min(j, longest) + 1):
                a, b = start[:alive] + (j - k), start[:alive] + j
                h = span_key(prefix, down, a, b)
                place = np.minimum(np.searchsorted(keys, h), unknown - 1)
                known = keys[place] == h
                pieces.append(np.where(known, place, unknown if k == 1 else -1))
            self.at.append(pieces)

    def forward(self, chance: np.ndarray) -> list[np.ndarray]:
        """For each end j the sum over segmentations of the first j letters; ``chance[..., piece]``.

        The last column of ``chance`` is 0, for spans that are no piece.
        """
        n = len(self.length)
        sums = [np.ones((n, chance.shape[0]))]
        for pieces in self.at[1:]:
            j, alive = len(sums), len(pieces[0])
            total = np.zeros((alive, chance.shape[0]))
            for k, piece in enumerate(pieces, start=1):
                total += sums[j - k][:alive] * chance.T[piece]
            sums.append(total)
        return sums

    def log_chances(self, chance: np.ndarray) -> np.ndarray:
        """Log probability of each string in each language."""
        sums = self.forward(chance)
        out = np.empty((len(self.length), chance.shape[0]))
        for j in np.unique(self.length):
            rows = np.flatnonzero(self.length == j)
            out[rows] = np.log(sums[j][rows])
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def expected(self, chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces over all segmentations, in one language; strings count ``weight`` times."""
        sums = self.forward(chance[None, :])
        weight = weight[self.order]
        last = len(self.at) - 1
        after = [np.zeros(len(x)) for x in sums]  # sums over segmentations of what follows j
        for j in range(last, -1, -1):
            ends = self.length[: len(after[j])] == j
            after[j][ends] = 1.0
            for k in range(1, PIECE_LETTERS + 1):
                if j + k <= last and k <= len(self.at[j + k]):
                    piece = self.at[j + k][k - 1]
                    after[j][: len(piece)] += chance[piece] * after[j + k][: len(piece)]
        whole = np.concatenate([sums[j][self.length[: len(sums[j])] == j, 0] for j in range(last, -1, -1)])
        counts = np.zeros(len(chance))
        for j in range(1, last + 1):
            for k, piece in enumerate(self.at[j], start=1):
                n = len(piece)
                share = sums[j - k][:n, 0] * chance[piece] * after[j] / whole[:n] * weight[:n]
                # "no piece" is numbered -1; its share is 0
                counts += np.bincount(piece + 1, weights=share, minlength=len(chance) + 1)[1:]
        return counts


def prefix_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prefix = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers("up", len(points)), out=prefix[1:])
    return prefix, powers("down", len(points) + 1)


def span_key(prefix: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))


def piece_keys(pieces: list[str]) -> np.ndarray:
    """Hashes of the pieces, sorted: a piece's number is its place here."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(p) for p in pieces])
    prefix, down = prefix_of(points)
    return np.sort(span_key(prefix, down, np.concatenate([[0], ends[:-1]]), ends))


class Model:
    """``chance[language, piece]``; the columns after the pieces: unknown letter, no piece."""

    def __init__(self, languages: list[str], prior: np.ndarray, keys: np.ndarray, chance: np.ndarray):
        self.languages, self.prior, self.keys, self.chance = languages, prior, keys, chance
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KNOWN_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        new = [w for w in words if w not in self.known]
        if not new:
            return
        parts = [stretches(w) for w in new]
        lattice = Lattice([p for x in parts for p in x], self.keys, PIECE_LETTERS)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[:-1]
        rows = np.add.reduceat(lattice.log_chances(self.chance), starts, axis=0)
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, rows])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counted = [Counter(words_in(t)) for t in texts]
        self._learn(set().union(*counted) if counted else set())
        names, scores = [], []
        for count in counted:
            if not count or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            if any(w not in self.known for w in count):  # forgotten while this batch was learnt
                self._learn(set(count))
            rows = np.fromiter((self.known[w] for w in count), dtype=np.int64, count=len(count))
            total = self.prior + np.fromiter(count.values(), dtype=np.float64, count=len(count)) @ self.scores[rows]
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def _count_words(batches):
    for batch in batches:
        count: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word in words_in(text):
                count[lang, word] += 1
        yield pa.record_batch(
            [
                pa.array([k[0] for k in count], pa.string()),
                pa.array([k[1] for k in count], pa.string()),
                pa.array(list(count.values()), pa.int64()),
            ],
            names=["lang", "word", "n"],
        )


def _expect(languages: list[str], keys: np.ndarray, chance: np.ndarray):
    def step(batches):
        total = np.zeros(chance.shape)
        for batch in gathered(batches, 1 << 15):
            by: dict[str, list] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for part in stretches(word):
                    by.setdefault(lang, []).append((part, n))
            for lang, rows in by.items():
                at = languages.index(lang)
                lattice = Lattice([r[0] for r in rows], keys, PIECE_LETTERS)
                total[at] += lattice.expected(chance[at], np.array([r[1] for r in rows], dtype=np.float64))
        total[:, -1] = 0
        lang, piece = np.nonzero(total)
        yield pa.record_batch(
            [pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])],
            names=["lang", "piece", "expected"],
        )

    return step


def fit(labelled: DataFrame, path: str | None = None, sample: int = SAMPLE_TEXTS, rounds: int = ROUNDS) -> Model:
    """A model of the languages of ``(doc_id, text, lang)``; what reaches the driver is bounded by the number of
    languages times the vocabulary."""
    keys = piece_keys(vocabulary(path or default_vocabulary()))
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    all_texts = sum(sizes.values())
    prior = np.log([sizes[x] / all_texts for x in languages]) if languages else np.zeros(0)
    chance = np.full((len(languages), len(keys) + 2), 1.0 / (len(keys) + 1))
    chance[:, -1] = 0
    if not languages:
        return Model(languages, prior, keys, chance)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample / sizes[lang])).otherwise(share)
    chosen = labelled.where(
        F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    ).select("lang", "text")
    words = stored(
        small_batches(chosen)
        .mapInArrow(_count_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n")),
        "words",
    )
    for _ in range(rounds):
        rows = (
            words.mapInArrow(_expect(languages, keys, chance), "lang int, piece int, expected double")
            .groupBy("lang", "piece")
            .agg(F.sum("expected").alias("expected"))
            .toPandas()
        )
        counts = np.zeros(chance.shape)
        counts[rows["lang"], rows["piece"]] = rows["expected"]
        counts[:, :-1] += SMOOTHING
        chance = counts / counts.sum(axis=1, keepdims=True)
    return Model(languages, prior, keys, chance)


def _predictions(parts: tuple, names: list[str], said: tuple[str, str]):
    def step(batches):
        model = Model(*parts)
        for batch in batches:
            lang, score = model.predict(batch.column("text").to_pylist())
            yield pa.record_batch(
                [*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*names, *said],
            )

    return step


def identify(
    docs: DataFrame, model: Model, keep: list[str], said: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language and its probability, under the names ``said``."""
    parts = (model.languages, model.prior, model.keys, model.chance)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in keep)
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    return small_batches(source).mapInArrow(
        _predictions(parts, keep, said), f"{schema}, `{said[0]}` string, `{said[1]}` double"
    )


def predicted_languages(docs: DataFrame, path: str | None = None, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; texts whose crc32(doc_id) leaves 2 modulo 4 teach nothing."""
    source = docs.select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    model = fit(source.where("NOT held_out").select("doc_id", "text", "lang"), path, sample)
    return identify(source.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])

