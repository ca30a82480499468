"""Pages of repeated keywords, links or product tags instead of sentences: robust outliers in spam-directed directions.

Each text is measured by densities (links, tags and prices, and the stretches without function words that hold them), by
repetition (words said again in stretches without function words, words said again and again within few words, repeated
runs of four words, the share of the two commonest words), and by the entropy of its content words. Per language their
robust centre and scatter are fitted over all texts. A document is flagged by its Mahalanobis distance alone, taken over
those of its deviations that point to where spam lies. No rule on the text decides anything.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.common import materialize, norm_key, release

#: Frequent function words of the four languages (fixed values).
FUNCTION_WORDS = {
    "en": "a about after all also although an and any are as at be because been before but by can could did do does for from had has have he her his i if in into is it its just may more most much no nor not of on one only or our out over she should so some such than that the their them then there these they this those though to too under until up very was we were what when where whereas which while who why will with without would you your",
    "de": "aber alle als also am an auch auf aus bei beim bis da damit das dass dem den denn der des die dies diese diesem dieser doch durch ein eine einem einen einer eines er erst es etwas für gegen hat haben ich ihm ihn ihr im in ins ist ja kann kein keine man mehr mich mir mit nach nicht noch nur ob oder ohne sehr sein sein seine sich sie sind so soll über um und uns unser unter vom von vor war waren was weil wenn wer wie wieder wir wird wurde zu zum zur zwei",
    "fr": "à alors au aucun aussi autre aux avant avec c car ce cela ces cet cette comme d dans de des donc du elle elles en encore entre est et eu fait il ils j je l la le les leur lui m mais même mes moins mon n ne ni nos notre nous on ont ou où par pas peu plus pour qu quand que qui s sa sans se ses si son sont sous sur ta te toujours tout toute très trop tu un une vos votre vous y",
    "es": "a al algo aquí así aunque como con contra cuando de del desde donde dos el ella ellos en entre era es esa ese eso esta está este esto fue ha hace hasta hay la las le les lo los más me mi mientras mucho muy nada ni no nos nosotros o otra otro para pero poco por porque que quien se según ser si sin sino sobre solo son su sus también tan tanto te tiene toda todo tu un una uno y ya yo",
}
WORDS_OF = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
ANY = frozenset().union(*WORDS_OF.values())

INVISIBLE = regex.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: What counts as one token: a link with its label, a tag (also a labelled list of them, prices, sizes, product codes), a word.
#: Every repetition is possessive and stops at the sign that would begin the token anew, so that any text takes linear time.
TOKEN = regex.compile(
    r"""<a\b[^<>]*+>[^<]*+</a>|\[[^\[\]\n]*+\]\([^()\s]*+\)|(?:https?://|www\.)[^\s<>"')\]]++
    |\#[\w-]++|\b(?:tags|keywords?|schlagwörter|stichwörter|mots[- ]clés|etiquetas|palabras[ ]clave)\s*+[:=][^\n]*+
    |[€$£]\s?\d[\d.,]*+|\d[\d.,]*+\s?(?:€|eur\b|usd\b|gbp\b)|\d++\s?[x×]\s?\d++|\b(?:sku|art|ref|no|nr|item)[.:\#-]?\s?\d++
    |[\p{L}\p{N}]++""",
    regex.X,
)
CODE = regex.compile(r"\d++[x×]\d++|(?:sku|art|ref|no|nr|item)\d++|\d++(?:eur|usd|gbp)")
SWAPPED = regex.compile(r"(?<=\p{L})[01345](?=\p{L}|\b)|\b[0345](?=\p{L})")
LETTERS = str.maketrans("01345", "oieas")
CONTENT, LINK, TAG, FUNCTION, NUMBER = range(5)

FEATURES = ["link_density", "tag_density", "marked_density", "bare_repetition", "chained_repetition", "phrase_repetition", "top_words", "word_entropy"]
#: Direction of spam in each feature, and the value that a text without any sign of it has.
TOWARDS = np.array([1, 1, 1, 1, 1, 1, 1, -1], float)
NEUTRAL = np.array([0, 0, 0, 0, 0, 0, 0, 1], float)
#: Each text is measured as if so many characters without any sign of spam followed: short texts prove little.
PRIOR = 160
#: A word is chained if it is said ``CHAIN`` times, each within ``NEAR`` words of the time before on average.
CHAIN, NEAR = 4, 12
#: Words repeated in a run of so many words are a repeated phrase.
PHRASE = 4
#: Characters measured at a time, the last text of a lot whole.
LOT = 2_000_000


class Words:
    """Numbers, kinds and lengths of the tokens of a lot; a letter written as a digit is the letter."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.kinds: list[int] = []
        self.sizes: list[int] = []
        self.langs: list[int] = []

    def add(self, word: str) -> int:
        plain = word if word[0] in "<[#" or not any(c in "01345" for c in word) else SWAPPED.sub(lambda m: m.group().translate(LETTERS), word)
        if plain != word and word.isalnum() and not CODE.fullmatch(word):
            self.ids[word] = self.number(plain)
        else:
            self.ids[word] = self._new(word)
        return self.ids[word]

    def number(self, word: str) -> int:
        got = self.ids.get(word)
        return self.add(word) if got is None else got

    def _new(self, word: str) -> int:
        if word[0] in "<[" or "://" in word or word.startswith("www."):
            kind = LINK
        elif not word.isalnum() or CODE.fullmatch(word):
            kind = TAG
        else:
            kind = NUMBER if word.isdigit() else FUNCTION if word in ANY else CONTENT
        self.kinds.append(kind)
        self.sizes.append(len(word))
        self.langs.append(sum(1 << i for i, k in enumerate(WORDS_OF) if word in WORDS_OF[k]))
        return len(self.kinds) - 1


def normal_text(text: str | None) -> str:
    """Composed, without entities and invisible signs, in lower case."""
    t = unicodedata.normalize("NFC", text or "")
    if "&" in t:
        t = html.unescape(t)
    return INVISIBLE.sub("", t).lower()


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features of each text (rows, see ``FEATURES``), its length in characters of tokens, the language of its function words."""
    words, doc, seq = Words(), [], []
    for i, text in enumerate(texts):
        found = TOKEN.findall(normal_text(text))
        ids = words.ids
        seq.extend([ids[w] if w in ids else words.add(w) for w in found])
        doc.append(len(found))
    n = len(texts)
    counts = np.array(doc, np.int64)
    doc, seq = np.repeat(np.arange(n), counts), np.array(seq, np.int64)
    if not len(seq):
        return np.tile(NEUTRAL, (n, 1)), np.zeros(n), [""] * n
    kinds, sizes, width = np.array(words.kinds), np.array(words.sizes, float), len(words.kinds)
    kind, size = kinds[seq], sizes[seq]
    index, edge = np.arange(len(seq)), np.r_[True, doc[1:] != doc[:-1]]
    total = lambda x: np.bincount(doc, weights=x, minlength=n)
    length = total(size)
    share = lambda x: total(size * x) / np.maximum(length, 1)
    content, word = kind == CONTENT, (kind != LINK) & (kind != TAG)
    link, tag, function = kind == LINK, kind == TAG, kind == FUNCTION

    # Counts of each word in its text.
    key = doc * width + seq
    unique, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    of, its = unique // width, unique % width
    counted = kinds[its] == CONTENT
    again = np.where(counted, (times - 1) * sizes[its], 0)
    order = np.lexsort((-again, of))
    at = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    top = np.bincount(of[order][at < 2], weights=again[order][at < 2], minlength=n) / np.maximum(length, 1)
    contents = total(content * 1.0)
    p = np.where(counted, times / np.maximum(contents[of], 1), 1)
    bits = np.bincount(of, weights=-p * np.log2(p), minlength=n)
    entropy = np.where(contents >= 2, bits / np.log2(np.maximum(contents, 2)), 1)

    # Words far from any function word; stretches without one, in which links and tags mark what stands between them.
    since = np.maximum.accumulate(np.where(function, index, -1))
    left = np.where(since >= np.maximum.accumulate(np.where(edge, index, 0)), index - since, 99)
    last = np.r_[edge[1:], True]
    until = np.minimum.accumulate(np.where(function, index, len(seq) + 99)[::-1])[::-1]
    right = np.where(until <= np.minimum.accumulate(np.where(last, index, len(seq) + 99)[::-1])[::-1], until - index, 99)
    bare = (np.minimum(left, right) >= 3) | (left + right >= 7)
    run = np.cumsum(edge | function | np.r_[False, function[:-1]]) - 1
    marked = np.bincount(run, weights=size * (link | tag)) / np.bincount(run, weights=size)

    # Words said ``CHAIN`` times within few words, and all that stands between.
    position, order = np.cumsum(word), np.lexsort((index, key))
    k = CHAIN - 1
    before = np.r_[np.full(k, -1), order[:-k]] if len(order) > k else np.full(len(order), -1)
    close = (before >= 0) & (key[before] == key[order]) & (position[order] - position[before] <= NEAR * k) & content[order]
    chained = _between(before[close], order[close], len(seq))

    # Runs of words that stand in the text twice or more.
    gram = seq.astype(np.uint64)
    for j in range(1, PHRASE):
        gram[:-j] = gram[:-j] * np.uint64(0x9E3779B97F4A7C15) + seq[j:].astype(np.uint64)
    gram ^= doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.flatnonzero(doc[: len(seq) - k] == doc[k:]) if len(seq) > k else np.empty(0, np.int64)
    _, same, often = np.unique(gram[starts], return_inverse=True, return_counts=True)
    starts = starts[often[same] >= 2]
    phrases = _between(starts, starts + k, len(seq))

    x = np.column_stack([
        share(link), share(tag), share(np.minimum(1, 2 * marked)[run]), share(bare & content & (times[inverse] >= 2)),
        share(chained & word), share(phrases & word), top, entropy,
    ])
    spoken = np.array(words.langs)[seq]
    hits = np.column_stack([total((spoken >> i & 1) * 1.0) for i in range(len(WORDS_OF))])
    names = [*WORDS_OF]
    langs = [names[b] if h[b] else "" for h, b in zip(hits, hits.argmax(1))]
    return (x * length[:, None] + NEUTRAL * PRIOR) / (length[:, None] + PRIOR), length, langs


def _between(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans from ``first`` to ``last``."""
    steps = np.bincount(first, minlength=size + 1) - np.bincount(last + 1, minlength=size + 1)
    return np.cumsum(steps)[:size] > 0


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, given, start, held = b.column(2).to_pylist(), b.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held < LOT and i + 1 < len(texts):
                continue
            x, length, found = measure(texts[start : i + 1])
            lang = [g if g in WORDS_OF else f for g, f in zip(given[start : i + 1], found)]
            columns = [b.column(0).slice(start, len(x)), pa.array(lang, pa.string()), pa.array(length), *[pa.array(c) for c in x.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "length", *FEATURES])
            start, held = i + 1, 0


#: Scale below which no feature's spread falls: five in a hundred characters.
FLOOR = 0.05
#: So many texts of the pooled fit are added to each language's own: a rare language leans on the others.
POOLED = 200
#: Quantiles of chi squared with eight degrees of freedom, beyond which a text is left out of the fit (0.975), and beyond
#: which it is flagged (1 - 1e-9: one false alarm in a billion texts, were texts normal).
TRIM, CUTOFF = 17.53, 61.4
ROUNDS = 5


class Fit:
    """Robust centre and inverse scatter of one language."""

    def __init__(self, centre: np.ndarray, scatter: np.ndarray):
        self.centre, self.scatter = centre, scatter
        self.inverse = np.linalg.inv(scatter + np.eye(len(centre)) * FLOOR**2)

    def distance(self, x: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distance."""
        d = x - self.centre
        return np.einsum("ij,jk,ik->i", d, self.inverse, d)

    def directed(self, x: np.ndarray) -> np.ndarray:
        """The same over the deviations that point to spam only."""
        d = x - self.centre
        return self.distance(self.centre + np.where(d * TOWARDS > 0, d, 0))


def fit_languages(measured: DataFrame) -> dict[str, Fit]:
    """Robust fit per language, and pooled under the empty name, over all texts that have any token.

    Starts from medians and the spread between the tenths; then moments without the texts that lie too far on spam's side,
    in ``ROUNDS`` rounds. One row a language and partition is added up, one a language reaches the driver.
    """
    rows, size = measured.where("length > 0"), len(FEATURES)
    q = rows.agg(*[F.percentile_approx(f, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), 1000).alias(f) for f in FEATURES]).first()
    if q is None or q[0] is None:
        return {}
    q = np.array([list(q[f]) for f in FEATURES], float)
    fits = dict.fromkeys(["", *WORDS_OF], Fit(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 2.563) ** 2)))
    for _ in range(ROUNDS):

        def sums(batches: Iterator[pa.RecordBatch], fits=fits) -> Iterator[pa.RecordBatch]:
            got = {k: np.zeros(1 + size + size * size) for k in fits}
            for b in batches:
                x = np.column_stack([b.column(f).to_numpy() for f in FEATURES])
                own = np.array(b.column("lang").to_pylist(), object)
                for name, fit in fits.items():
                    part = x if name == "" else x[own == name]
                    part = part[fit.directed(part) < TRIM]
                    got[name] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([*got]), pa.array([v.tolist() for v in got.values()])], names=["lang", "s"])

        parts = rows.select("lang", *FEATURES).mapInArrow(sums, "lang string, s array<double>")
        added = parts.groupBy("lang").agg(F.array(*[F.sum(F.element_at("s", i + 1)) for i in range(1 + size + size * size)]).alias("s")).collect()
        moments = {r.lang: np.array(r.s) for r in added}
        pooled = moments[""]
        for name, m in moments.items():
            m = m + pooled * (POOLED / max(pooled[0], 1.0))
            mean = m[1 : 1 + size] / m[0]
            fits = fits | {name: Fit(mean, m[1 + size :].reshape(size, size) / m[0] - np.outer(mean, mean))}
    return fits


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, lang, length, distance, directed, flagged, ...features)`` of every text.

    ``flagged``: the squared Mahalanobis distance of the text from its language's robust centre, over deviations in the
    direction of spam only, exceeds ``CUTOFF``. A null, blank or unknown language is taken from the text's function words,
    one without any belongs to the pooled fit. Null, empty and blank texts aren't flagged and don't enter the fit. Texts
    are measured whole; repeated rows each have their row; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("key"), norm_key(lang).alias("lang"), F.col(text).alias("text"))
    kind, features = rows.schema["key"].dataType.simpleString(), ", ".join(f"{f} double" for f in FEATURES)
    measured = materialize(rows.mapInArrow(_measured, f"key {kind}, lang string, length double, {features}"), "measured")
    fits = fit_languages(measured)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy() for f in FEATURES])
            own, some = np.array(b.column("lang").to_pylist(), object), b.column("length").to_numpy() > 0
            distance, directed = np.zeros(len(x)), np.zeros(len(x))
            for name, fit in fits.items():
                at = (own == name) & some
                distance[at], directed[at] = fit.distance(x[at]), fit.directed(x[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(distance), pa.array(directed), pa.array(directed > CUTOFF), *b.columns[3:]], names=["key", "lang", "length", "distance", "directed", "flagged", *FEATURES])

    return measured.mapInArrow(score, f"key {kind}, lang string, length double, distance double, directed double, flagged boolean, {features}").withColumnRenamed("key", key)
