"""Quality and toxicity from weak labels.

Overlapping heuristic labellers vote on each text: good, bad, or no vote. Expectation-maximisation over the counts of
vote patterns estimates how each labeller votes given the hidden class, and so a posterior for every pattern. The
posterior labels of a bounded sample train a linear scorer over hashed words, word beginnings and word shapes, which
scores all texts.

The quality labellers look at odd characters, shouting, repetition, sentence lengths, function words, vocabulary and
empty words. The toxicity labellers have four sources: a list of insults; two lexicons of words and word beginnings
that mark toxic texts, learnt apart from two halves of a bounded sample of labelled texts (where labels are given);
and disguised spellings of the list. A lexicon alone is often wrong on a rare word; how far each may be trusted is
what expectation-maximisation finds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm import kernels as K
from shapeloom.llm.common import discard, id_and_text, written

#: Texts that the scorer is fitted on at most, labelled texts that the lexicons are learnt from at most, entries of a
#: lexicon at most, and hashed features.
SAMPLE, LABELLED, ENTRIES, FEATURES = 2000, 8000, 4096, 1 << 18
#: Bytes of a word's beginning, and the lower bound of a lexicon entry's share of toxic texts (two deviations).
STEMS, SURE = (4, 6, 8), 0.4
#: Texts of the sample that a feature must occur in, and texts that a class is given beforehand of each feature.
LEAST, BEFORE = 5, 2.0
#: A posterior that decides alone; below, the mean of posterior and scorer does.
CERTAIN = 0.99
# Frequent words of English, German, French and Spanish, and insults.
STOP_WORDS = (
    "the of and to in is it that for on with as was by be this are from or an at not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et un une du en que qui dans pour par sur au pas avec est "
    "el la los las de y en que un una por con para es se del lo como su al"
)
INSULTS = "idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown clowns dumb dumbass fool jerk bastard bitch asshole shit fuck fucking retard retarded vermin filthy hate kill"
_STOP = {w.encode() for w in STOP_WORDS.split()}
_INSULT_TEXT = set(INSULTS.split())
_INSULT_HASH = np.sort(K.word_hashes(*K.text_bytes(pa.array([INSULTS])))[0])
_TRIM = b".,;:!?\"'()[]|%$#&*"
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


# Characters that disguise a letter.
_DISGUISE = str.maketrans("013457@$!|", "oieastasii")
_PLAIN = {re.sub(r"(.)\1+", r"\1", w) for w in INSULTS.split()}
#: Votes of a text: quality labellers, then toxicity labellers.
QUALITY, TOXIC = 7, 4


def _pick(bad: bool, good: bool) -> int:
    return 2 if bad else 1 if good else 0


def quality_votes(text: bytes) -> list[int]:
    """Votes of the quality labellers: 1 good, 2 bad, 0 none. A text without words gets one bad vote."""
    words = text.split()
    n = len(words)
    if not n:
        return [2, *[0] * (QUALITY - 1)]
    low = [w.strip(_TRIM).lower() for w in words]
    size = len(text)
    odd = sum(text.count(c) for c in (b"%", b"$", b"#", b"&", b"*", b"|", b"!", b"=", b"<", b">", b"{", b"}")) / size
    upper, lower = (sum(text.count(bytes([c])) for c in span) for span in (range(65, 91), range(97, 123)))
    shout = upper / max(1, upper + lower)
    repeat = sum(a == b for a, b in zip(low, low[1:], strict=False)) / n
    distinct = len(set(low)) / n
    stops = sum(w in _STOP for w in low) / n
    ends = sum(text.count(c) for c in (b". ", b".\n", b"? ", b"! ")) + text.endswith((b".", b"?", b"!"))
    long = n / max(1, ends)
    return [
        _pick(odd > 0.06, odd < 0.015),
        _pick(shout > 0.5, shout < 0.15),
        _pick(repeat > 0.15, repeat < 0.05) if n >= 8 else 0,
        _pick(long > 60 or long < 1.5, 3 < long < 40) if n >= 12 else 0,
        _pick(stops < 0.03, stops > 0.08) if n >= 20 else 0,
        _pick(distinct < 0.2, distinct > 0.3) if 20 <= n <= 2000 else 0,
        _pick(low.count(b"") > 0.2 * n, low.count(b"") < 0.05 * n),
    ]


def _disguised(texts: pa.Array) -> np.ndarray:
    """Whether a word with digits, signs or stretched letters reads as a listed insult without them, for each text."""
    body, rows = K.text_bytes(texts)
    hit = np.zeros(len(texts), bool)
    if len(body) < 3:
        return hit
    low = K.lower_bytes(body)
    letter, sign = (low >= 97) & (low <= 122), np.isin(low, np.frombuffer(b"013457@$!|", np.uint8))
    inside = letter[:-2] & sign[1:-1] & (letter[2:] | sign[2:])
    stretched = letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    starts, ends = K.word_places(body, rows)
    word = np.unique(np.searchsorted(starts, np.flatnonzero(inside | stretched), "right") - 1)
    word = word[(ends - starts)[word] <= 24] if len(starts) else word[:0]
    row = np.searchsorted(rows, starts[word], "right") - 1
    for a, b, r in zip(starts[word].tolist(), ends[word].tolist(), row.tolist(), strict=True):
        text = low[a:b].tobytes().strip(_TRIM).decode("utf-8", "replace")
        if not hit[r] and text not in _INSULT_TEXT:
            hit[r] = re.sub(r"(.)\1+", r"\1", text.translate(_DISGUISE)) in _PLAIN
    return hit


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row of each word, hashes of whole words, and of their beginnings in STEMS bytes (0 for shorter words)."""
    body, rows = K.text_bytes(texts)
    body = np.where(np.isin(body, np.frombuffer(_TRIM, np.uint8)), np.uint8(32), body)
    whole, offsets = K.word_hashes(body, rows, lower=True)
    return K.row_of(offsets), whole, K.word_beginnings(body, rows, STEMS)


def toxic_votes(texts: pa.Array, lexicons: list[np.ndarray]) -> np.ndarray:
    """Votes of the toxicity labellers on each text: 1 harmless, 2 toxic, 0 none. Without a lexicon there is no vote."""
    row, whole, stems = _words(texts)
    votes = np.zeros((len(texts), TOXIC), np.int64)

    def marked(hashes: list[np.ndarray], known: np.ndarray) -> np.ndarray:
        hit, low = np.zeros(len(texts), bool), np.zeros(1 << 16, bool)
        low[known & np.uint64(0xFFFF)] = True
        for h in hashes:
            at = np.flatnonzero(low[h & np.uint64(0xFFFF)])
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            hit[row[at[known[place] == h[at]]]] = True
        return np.where(hit, 2, 1)

    votes[:, 0] = marked([whole], _INSULT_HASH)
    for k, lexicon in enumerate(lexicons[:2]):
        if len(lexicon):
            votes[:, 1 + k] = marked([whole, *stems], lexicon)
    votes[:, 3] = np.where(_disguised(texts), 2, 1)
    return votes


def posteriors(patterns: np.ndarray, counts: np.ndarray, prior_bad: float, alarm: float = 0.15, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The probability of the bad class for each row of votes, and each labeller's table of votes given the class."""
    if not len(patterns):
        return np.zeros(0), np.zeros((2, 0, 3))
    n = patterns.shape[1]
    # a start at which labellers are better than chance keeps the classes from changing places; alarm: how often they
    # speak of bad in good texts
    table = np.tile(np.array([[0.25, 0.75 - alarm, alarm], [0.25, 0.25, 0.5]])[:, None, :], (1, n, 1))
    prior = np.array([1 - prior_bad, prior_bad])
    for _ in range(rounds):
        log = np.log(prior) + np.stack([np.log(table[c, np.arange(n), patterns]).sum(axis=1) for c in (0, 1)], axis=1)
        share = np.exp(log - log.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        weight = share * counts[:, None]
        prior = (weight.sum(axis=0) + 1) / (counts.sum() + 2)
        for v in range(3):
            table[:, :, v] = np.stack([(weight[:, c, None] * (patterns == v)).sum(axis=0) for c in (0, 1)]) + 0.01
        table /= table.sum(axis=2, keepdims=True)
    # the bad class is the one in which labellers speak of bad more often
    bad = int(table[1, :, 2].sum() >= table[0, :, 2].sum())
    return share[:, bad], table if bad else table[::-1]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hashed words, beginnings and shapes that each text holds, and each text's offsets."""
    row, whole, stems = _words(texts)
    body, rows = K.text_bytes(texts)
    shapes, offsets = K.word_hashes(_SHAPE[body], rows)
    block = FEATURES // 4
    parts = [(row, whole), (row, stems[0]), (row, stems[1]), (K.row_of(offsets), shapes)]
    keys = [r * FEATURES + (h % np.uint64(block)).astype(np.int64) + k * block for k, (r, h) in enumerate(parts)]
    # a word that is too short for a beginning has none
    keys[1:3] = [key[h != 0] for key, (_, h) in zip(keys[1:3], parts[1:3], strict=True)]
    key = np.unique(np.concatenate(keys))
    return key % FEATURES, np.searchsorted(key // FEATURES, np.arange(len(texts) + 1))


def fit(number: np.ndarray, bounds: np.ndarray, target: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic scorer, bias last, for target probabilities.

    A feature's value is the logarithm of how much more often it occurs in the class than outside; gradient descent
    with step sizes of their own and a penalty on large weights finds how far each value counts.
    """
    n, made = len(target), np.zeros(FEATURES + 1)
    total = target.sum()
    if not n or total < 1 or n - total < 1:
        made[-1] = 0.0 if not n else np.log((total + 0.5) / (n - total + 0.5))
        return made
    row = np.repeat(np.arange(n), np.diff(bounds))
    seen, inside = np.bincount(number, minlength=FEATURES), np.bincount(number, target[row], FEATURES)
    share = total / n
    ratio = np.log((inside + BEFORE * share) / (seen - inside + BEFORE * (1 - share))) - np.log(share / (1 - share))
    ratio[seen < LEAST] = 0
    used = ratio[number] != 0
    number, row = number[used], row[used]
    value = ratio[number]
    w, power, bias, bias_power = np.full(FEATURES, 0.1), np.full(FEATURES, 1e-8), -2.0, 1e-8
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    for _ in range(rounds):
        z = np.bincount(row, w[number] * value, n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance / n
        slope = np.bincount(number, error[row] * value, FEATURES) + 1e-3 * w
        power += slope**2
        w -= 0.05 * slope / np.sqrt(power)
        bias_power += error.sum() ** 2
        bias -= 0.2 * error.sum() / np.sqrt(bias_power)
    made[:-1], made[-1] = w * ratio, bias
    return made


def _code(votes) -> np.ndarray:
    """Vote patterns as whole numbers, to base three."""
    votes = np.asarray(votes, np.int64)
    return votes @ 3 ** np.arange(votes.shape[1])


def _patterns(codes: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(labellers)], axis=1)


def _codes(texts: pa.Array, lexicons: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    quality = [quality_votes((t or "").encode()) for t in texts.to_pylist()]
    return _code(quality), _code(toxic_votes(texts, lexicons))


def _vote(lexicons, share: float):
    """Patterns of all texts; of about a ``share`` of the texts also the features, for the scorer's sample."""

    def run(batches):
        for batch in batches:
            for a, b in K.slices(batch.column(1)):
                texts = batch.column(1)[a:b]
                codes = _codes(texts, lexicons)
                lot = batch.column(2)[a:b].to_numpy(zero_copy_only=False)
                drawn = np.flatnonzero(lot < share)
                number, bounds = features(texts.take(pa.array(drawn)))
                made = [None] * (b - a)
                for i, x, y in zip(drawn.tolist(), bounds, bounds[1:], strict=False):
                    made[i] = number[x:y].astype("<u4").tobytes()
                columns = [pa.array(codes[0]), pa.array(codes[1]), pa.array(lot), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["quality", "toxic", "lot", "features"])

    return run


def _score(weights, chance, lexicons):
    def run(batches):
        for batch in batches:
            for a, b in K.slices(batch.column(1)):
                texts = batch.column(1)[a:b]
                number, bounds = features(texts)
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                made = []
                for w, known, code in zip(weights, chance, _codes(texts, lexicons), strict=True):
                    z = np.bincount(row, w[number], b - a) + w[-1]
                    made += [1 / (1 + np.exp(-np.clip(z, -30, 30))), np.array([known[c] for c in code.tolist()])]
                columns = [batch.column(0)[a:b], pa.array(1 - made[0]), pa.array(1 - made[1]), pa.array(made[2]), pa.array(made[3])]
                names = ["doc_id", "quality", "quality_posterior", "toxicity", "toxic_posterior"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _marks(batches):
    """(mark, half, texts, toxic): distinct words and beginnings of labelled texts, counted for each slice."""
    for batch in batches:
        for a, b in K.slices(batch.column(0)):
            texts = batch.column(0)[a:b]
            toxic, half = (batch.column(k)[a:b].to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            row, whole, stems = _words(texts)
            row, mark = np.tile(row, 1 + len(STEMS)), np.concatenate([whole, *stems])
            order = np.lexsort((row, mark))
            row, mark = row[order], mark[order]
            once = (mark != 0) & np.concatenate([[True], (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])])[: len(mark)]
            row, mark = row[once], mark[once]
            order = np.lexsort((half[row], mark))
            row, mark = row[order], mark[order]
            begin = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (half[row][1:] != half[row][:-1])])) if len(row) else np.zeros(0, int)
            count = np.diff(np.append(begin, len(row)))
            bad = np.add.reduceat(toxic[row], begin) if len(begin) else np.zeros(0, int)
            columns = [pa.array(mark[begin].view(np.int64)), pa.array(half[row][begin]), pa.array(count), pa.array(bad)]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "half", "texts", "toxic"])


def lexicons(docs: DataFrame, labels: DataFrame | None, labelled: int = LABELLED) -> list[np.ndarray]:
    """Two lexicons, each the hashes of words and word beginnings that mark toxic texts in one half of the labelled ones.

    At most ``labelled`` rows of ``labels`` (doc_id, toxic) are drawn by a hash of the id, and broadcast to the texts.
    An entry's share of toxic texts exceeds SURE by two deviations; of more than ENTRIES entries the surest stay.
    """
    if labels is None:
        return [np.zeros(0, np.uint64)] * 2
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lot = F.xxhash64("doc_id", F.lit(1))
    drawn = known.orderBy(lot, "doc_id").limit(labelled).select("doc_id", "toxic", F.pmod(lot, F.lit(2)).alias("half"))
    texts = docs.join(F.broadcast(drawn), "doc_id").select("text", "toxic", "half")
    counts = texts.mapInArrow(_marks, "mark long, half long, texts long, toxic long")
    counts = counts.groupBy("mark", "half").agg(F.sum("texts").alias("n"), F.sum("toxic").alias("k")).where("k >= 3")
    # Wilson's lower bound of the share
    z, n, p = 2.0, F.col("n"), F.col("k") / F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    sure = counts.withColumn("low", low).where(F.col("low") >= SURE)
    found = []
    for half in (0, 1):
        own = sure.where(F.col("half") == half).orderBy(F.desc("low"), "mark").limit(ENTRIES)
        found.append(np.sort(own.select("mark").toPandas()["mark"].to_numpy(np.int64).view(np.uint64)))
    return found


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality and toxicity of every whole text.

    ``labels`` (doc_id, toxic: 0 or 1) may name toxic texts among ``docs``; two labellers learn from at most
    ``labelled`` of them, and abstain without any. Repeated labels of an id count once, the highest; null ones do not.
    Returns for each row of ``docs``: doc_id, quality and toxicity (the scorer's probabilities), quality_posterior and
    toxic_posterior (of its labellers' votes), toxic (a certain posterior, or posterior and scorer
    on average), keep (neither toxic nor
    of low quality).
    The scorer is fitted on at most ``sample`` texts, drawn by a hash of id and text; all else covers all texts. A
    null or empty text is of low quality. Null ids and repeated rows pass through, rows alike in text score alike.
    Other columns are not read. No rows give no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    marks = lexicons(rows, labels, labelled)
    # a lot from 0 to 1 for each row, so that the sample's size is known before a text is looked at
    lot = (F.xxhash64("doc_id", "text", F.lit(2)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("lot")
    total = rows.count()
    voted = rows.select("doc_id", "text", lot).mapInArrow(_vote(marks, sample / max(total, 1)), "quality long, toxic long, lot double, features binary")
    voted = written(voted, "votes")
    # at most 3**11 patterns
    seen = voted.groupBy("quality", "toxic").agg(F.count("*").alias("n")).toPandas()
    chance = []
    for name, labellers, prior, alarm in (("quality", QUALITY, 0.2, 0.15), ("toxic", TOXIC, 0.1, 0.02)):
        grouped = seen.groupby(name)["n"].sum()
        codes = grouped.index.to_numpy(np.int64)
        bad = posteriors(_patterns(codes, labellers), grouped.to_numpy(np.float64), prior, alarm)[0]
        chance.append(dict(zip(codes.tolist(), bad.tolist(), strict=True)))
    drawn = voted.where("features is not null").orderBy("lot").limit(sample).collect()
    discard(voted)
    number = [np.frombuffer(r.features, "<u4").astype(np.int64) for r in drawn]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in number])]).astype(np.int64)
    number = np.concatenate([np.zeros(0, np.int64), *number])
    targets = [np.array([chance[k][r[k]] for r in drawn]) for k in (0, 1)]
    weights = [fit(number, bounds, t).astype(np.float32) for t in targets]
    schema = "doc_id long, quality double, quality_posterior double, toxicity double, toxic_posterior double"
    found = rows.mapInArrow(_score(weights, chance, marks), schema)
    both = F.col("toxic_posterior") + F.col("toxicity")
    found = found.withColumn("toxic", (F.col("toxic_posterior") >= CERTAIN) | (both >= 1.0))
    return found.withColumn("keep", ~F.col("toxic") & (F.col("quality") + F.col("quality_posterior") >= 1.0))
