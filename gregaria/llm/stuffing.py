"""Keyword-stuffed and link-list pages, as robust outliers.

A text is cut into lines, and each line is taken for links, for code or data
(by its share of signs), for a sentence (by its function words) or for loose
words. From these come six features: the share of characters in lines of
recurring loose words or links (``density``), in links, of recurring words
anywhere but in code (``repetition``), of words that are no function words, and
of code and data, and the entropy of the words. None of them decides.

For every language the robust centre and scatter of the features over its
distinct texts give a Mahalanobis distance. A document is spam if its distance
is large and its deviation points in the spam direction; both are gates, and a
text far off in another direction (all code in a language of prose, say) fails
the second. The centre of a language with few texts leans on that of the whole
corpus, and bounds on centre and scale keep copies or a majority of spam from
becoming the norm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gregaria.operators.skew import skew_join
from gregaria.sources.scratch import Scratch
from gregaria.sources.tables import spread
from gregaria.sources.workers import on_workers

FEATURES = ["density", "links", "entropy", "repetition", "no_function_words", "code"]
# The side of each feature on which spam lies.
SPAM_DIRECTION = [1, 1, -1, 1, 1, -1]
MIN_DISTANCE = 5.5
MIN_DIRECTION = 0.3
# Bounds of what may be the norm of a language, and the least scale of each feature; no scale is above 1.3 times that.
CENTRE_BOUNDS = [(0, 0.15), (0, 0.15), (0.8, 1), (0, 0.2), (0, 0.6), (0, 0.3)]
SCALES = [0.1, 0.1, 0.1, 0.1, 0.25, 0.15]
SCALE_RANGE = 1.3
SHRINK = 0.3  # of the correlations towards none
PRIOR_TEXTS = 50  # with so many texts a language counts as much as the corpus
HOT_SHARE = 1 / 64
BROADCAST_LANGUAGES = 10_000  # rows of less than a kilobyte

# Function words of the larger languages, which sentences hold and keyword lists lack.
FUNCTION_WORDS = frozenset(
    """the a an and or but of to in on at by for from with as is are was were be been has have had it its this that these those
    there not no we you they he she i your our their which what who when if then than so until before since must should can will would may us
    der die das und oder ein eine ist sind nicht mit von zu auf den dem des im für wir sie er es wird wurde
    le la les un une et ou est sont pas avec de du des dans pour nous vous il elle ce cette que qui
    el los las una y o es son no con en por para que se su este esta
    o os as um uma e do da em não com que se por para
    il lo gli uno che non con per di del della sono
    het een en van niet met voor zijn dat op
    i w z na do nie się jest że to dla
    ve bir bu için ile da de değil
    и в на не что с по это для как но из у за от
    的 了 是 在 和 不 我 你 这 這 有 也 就 与 與 及 或 为 為 把 被 从 從 会 會 能 は を が に で と も ที่ และ ของ เป็น ไม่ ได้ ใน จะ ให้""".split()
)

URL = re.compile(r"(?:(?:https?|ftp)://|\bwww\.(?=[\w-]+\.\w))([^\s/\"'<>\])]+)[^\s\"'<>\])]*")
# A link that is the value of a field, such as an element other than an anchor, or a key that stands alone before it.
FIELD = re.compile(r"(?:<(?!a\b)[\w:-]+>\s*|^\s*-?\s*[\w-]+\s*[:=]\s*|[\w-]+\"\s*:\s*\"|^\s*\w+ \")$")
TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*>")
NAMED_LINK = re.compile(r"\[url=\s*\](.*?)\[/url\]|\[([^\[\]]*)\]\(\s*\)", re.I)
LEAD = re.compile(r"^(?:[\s>*•+\-\ufeff]|//+|/\*+|--|#+(?=\s)|\"{3}|'{3}|<!--|\d+[.)]\s)+|(?:\*/|-->|\"{3}|'{3}|\s)+$")
PAIR = re.compile(r"[{\[\s]*(?:[\w<>]+ ){0,3}?[\"']?([\w.$@-]+)[\"']?\s*(?::=|=>|[:=])\s*(?=\S)")
ENCLOSING = " \t{}[](),;\"'`"
STRUNG = re.compile(r"[\w\s,;|/-]+")
WORD = re.compile(r"[^\W\d_]+")
SIGN = re.compile(r"[{}()\[\]=<>\\\"`~^&@%+:]|\$(?!\d)|;(?=\S|$)|\.(?=[^\W\d])|_(?=\w)|[A-Z](?<=[a-z][A-Z])|\d(?<=[^\W\d_]\d)")
SURE_SIGN = re.compile(r"[{}(=]")  # of these, those that no wrapper, list or tag holds, to pass most lines of code by at once
SEPARATOR = re.compile(r"[,;|/•·*、，；]|\s[-–—]\s")
HASHTAGS = re.compile(r"(?:^|(?<=[\s\"']))(?:#[^\s#\"{}:;]*[^\W\d_][^\s#\"{}:;]*\s*)+(?![{:;])")
DIRECTIVE = re.compile(r"\s*#\s*(?:end\w*|else|if\w*|define|include|pragma|undef|error|line|region)\b")
# Scripts without spaces between words, and signs that sentences in them hold.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f]+")
FUNCTION_SIGNS = re.compile("[的了是在和不我你这這有也就与與及或为為把被从從会會能はをがにでとも]|ที่|และ|ของ|เป็น|ไม่|ได้|ใน|จะ|ให้")

SENTENCE = re.compile(r"(?<=[.!?。])\s+|\s[-–—]\s+")

MAX_SIGNS = 0.08  # a letter, in text that is not code or data
MIN_LETTERS = 0.5  # of the characters of text that is not data
MIN_FUNCTION_WORDS = 0.12  # of the words of a sentence
LINK_LINE = 0.3  # of the characters of a line of links
RECURRING = 0.5  # of the words of a line, for the line to count as a string of recurring words
SOME, OFTEN, HEAVY = 0.002, 0.01, 0.1  # of all words, for a word to recur, to recur often, and to make up sentences
RECURRING_IN_PHRASES = 0.25  # the same for a line of phrases, not single words


def _grams(line: str) -> list[str]:
    """The words of a line, those of scripts without spaces as pairs of characters."""
    if line.isascii():
        return WORD.findall(line.lower())
    grams = WORD.findall(UNSPACED.sub(" ", line).lower())
    for run in UNSPACED.findall(line):
        for part in FUNCTION_SIGNS.split(run):
            grams += [part[i : i + 2] for i in range(max(1, len(part) - 1))] if part else []
        grams += FUNCTION_SIGNS.findall(run)
    return grams


def _size(text: str) -> int:
    return len(text) - sum(map(text.count, " \n\t\r\ufeff"))


def _stripped(line: str) -> str:
    """A line without the marks of lists, headings and comments around it."""
    line = line.strip()
    return LEAD.sub("", line) if line and (line[0] in "*>•+-/#\"'<\ufeff0123456789" or line[-1] in "/>\"'") else line


def _bare(line: str, pair: re.Match | None, keys: Counter[str]) -> str:
    """A line without what encloses it; of a field only its value, if that is a list or stands under a key that recurs."""
    value = (line[pair.end() :] if pair else line).strip(ENCLOSING)
    if pair and keys[pair[1]] < 8 and len(SEPARATOR.findall(value)) < 2:
        return line
    return value.replace("_", " ") if "_" in value and STRUNG.fullmatch(value) else value if pair or line[:1] in "\"'" else line


class _Links:
    """The links of a text by host, as characters and the words that name them."""

    def __init__(self) -> None:
        self.hosts: dict[str, list[tuple[float, set[str]]]] = {}

    def add(self, found: list[re.Match], size: int, label: list[str]) -> None:
        for m in found:
            path = m[0][m.end(1) - m.start() :]
            self.hosts.setdefault(m[1], []).append((size / len(found), {*label, *WORD.findall(path.lower())}))

    def own_pages(self) -> float:
        """Characters of links to a host with a third of all that are named by words of their own, as an index of pages is."""
        n = sum(map(len, self.hosts.values()))
        own = 0.0
        for links in self.hosts.values():
            if len(links) > 2 and 3 * len(links) >= n:
                counts = Counter(w for _, words in links for w in words)
                own += sum(size for size, words in links if any(counts[w] == 1 for w in words))
        return own


def profile(text: str | None) -> tuple[float, ...]:
    """The values of ``FEATURES`` for a text: 0, with entropy 1, for a null, empty or blank one.

    The whole text counts, whatever its length; markup counts as nothing.
    """
    if not text or text.isspace():
        return 0.0, 0.0, 1.0, 0.0, 0.0, 0.0
    lines = [(line, PAIR.match(line)) for line in map(_stripped, text.splitlines()) if line]
    keys = Counter(m[1] for _, m in lines if m)
    total = code = linked = text_letters = 0
    links = _Links()
    loose: list[tuple[int, list[str], float]] = []  # characters, words, least share of recurring words
    words: list[str] = []
    sentences: Counter[str] = Counter()
    for line, pair in lines:
        if not pair and "#" not in line and "<" not in line and "//" not in line and len(SURE_SIGN.findall(line)) > MAX_SIGNS * len(line):
            size = len(line) - line.count(" ") - line.count("\t")
            total += size
            code += size
            continue
        found, data = [], 0
        if "://" in line or "www." in line:
            for m in URL.finditer(line):
                if FIELD.search(line, 0, m.start()):
                    data += len(m[0])
                else:
                    found.append(m)
            line = URL.sub(" ", line)
            if found:
                line = NAMED_LINK.sub(r" \1\2 ", line)
        if "<" in line:
            line = TAG.sub(" ", line)
            line = line.strip()
        in_links = sum(len(m[0]) for m in found)
        own = _size(line)
        size = own + in_links
        total += size + data
        code += data
        if not size:
            continue
        if not found:
            bare = _bare(line, pair, keys)
            if bare is not line:
                rest = _size(bare)
                code += own - rest
                line, own, size = bare, rest, rest
        tagged = 0
        if "#" in line and not DIRECTIVE.match(line):
            tagged = sum(len(m[0].strip()) for m in HASHTAGS.finditer(line))
            line = HASHTAGS.sub(lambda m: re.sub(r"[\W\d_]", " ", m[0]), line)
            tagged = tagged if tagged > 0.8 * own else 0
        signs = len(SIGN.findall(line))
        if not found and signs > MAX_SIGNS * len(line):
            code += size
            continue
        grams = _grams(line)
        letters = sum(map(len, grams))
        functional = sum(map(FUNCTION_WORDS.__contains__, grams))
        script = 0 if line.isascii() else len("".join(FUNCTION_SIGNS.findall(line)))
        dense = bool(own) and (signs > MAX_SIGNS * letters or letters < MIN_LETTERS * own or line.find(";") == len(line) - 1)
        if in_links >= LINK_LINE * size and found and (functional < 2 or functional < MIN_FUNCTION_WORDS * len(grams)) and not (dense and signs > 2 * len(found)):
            links.add(found, size, grams)
            linked += size
            text_letters += letters
            words += grams
        elif dense or DIRECTIVE.match(line):
            code += size
        else:
            text_letters += letters
            ended = functional and line[-1:] in ".!?"
            sentence = functional >= MIN_FUNCTION_WORDS * len(grams) and (functional >= 2 or ended) or script and script >= MAX_SIGNS * letters
            if sentence:
                sentences.update(SENTENCE.split(line))
            else:
                words += grams
                phrases = len(grams) >= 1.6 * (1 + len(SEPARATOR.findall(line)))
                loose.append((size, grams, 0.0 if tagged else RECURRING_IN_PHRASES if phrases else RECURRING))
    if not total:
        return 0.0, 0.0, 1.0, 0.0, 0.0, 0.0
    linked -= links.own_pages()
    said = [(part, times, _grams(part)) for part, times in sentences.items()]
    # a sentence counts once here, however often it is repeated: what recurs in different ones is a keyword
    content = Counter(w for grams in (words, *(grams for *_, grams in said)) for w in grams if w not in FUNCTION_WORDS)
    n = content.total()
    some, often, heavy = ({w for w, c in content.items() if c >= max(least, share * n)} for least, share in ((2, SOME), (3, OFTEN), (4, HEAVY)))
    strung = sum(size for size, grams, least in loose if sum(map(some.__contains__, grams)) >= least * len(grams))
    again = sum(len(w) for w in words if w in often)
    n_words, functional, prose = len(words), sum(map(FUNCTION_WORDS.__contains__, words)), 0
    for part, times, grams in said:
        own = [w for w in grams if w not in FUNCTION_WORDS]
        n_words += times * len(grams)
        functional += times * (len(grams) - len(own))
        again += times * sum(len(w) for w in own if w in often)
        if own and sum(map(heavy.__contains__, own)) >= RECURRING * len(own):
            strung += times * _size(part)
        else:
            prose += times * sum(map(len, grams))
    entropy = -sum(c / n * math.log(c / n) for c in content.values()) / math.log(n) if n > 1 else 1.0
    # words among code, links and, for entropy, sentences count by their share of the text
    return (
        min(1.0, (strung + linked) / total),
        min(1.0, linked / total),
        1.0 - min(1.0, max(0, text_letters - prose) / total) * (1.0 - entropy),
        min(1.0, again / total),
        min(1.0, text_letters / total) * (1.0 - functional / max(1, n_words)),
        min(1.0, code / total),
    )


def profile_texts(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``FEATURES`` of every row."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([profile(t.as_py()) for t in batch.column(text)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c) for c in values.T)], names=[*keep, *FEATURES])

    return on_workers(spread(rows.select(*keep, text))).mapInArrow(run, f"{kinds}, " + ", ".join(f"{f} double" for f in FEATURES))


def _median(values) -> F.Column:
    return F.percentile_approx(values, F.lit(0.5), F.lit(10_000))


def _leaning(own: str, all_of: float) -> F.Column:
    """A language's value drawn towards the corpus's, the more the fewer its texts."""
    return (F.col(own) * F.col("n") + all_of * PRIOR_TEXTS) / (F.col("n") + PRIOR_TEXTS)


def _with_group(rows: DataFrame, groups: DataFrame, group: str, n_groups: int) -> DataFrame:
    """Rows with the values of their group: by broadcast for a number of groups that was counted to be small, else by shuffle with hot groups apart."""
    return rows.join(F.broadcast(groups), group) if n_groups <= BROADCAST_LANGUAGES else skew_join(rows, groups, group, HOT_SHARE)


def robust_scatter(profiles: DataFrame, group: str, n_groups: int) -> DataFrame:
    """For every group the centres and scales of ``FEATURES`` and the inverse of their winsorised correlation.

    Medians and median absolute deviations come from mergeable quantile
    sketches over all rows; deviations are cut at 3 scales before their
    products are averaged, so a minority of outliers moves neither. A row a
    group; groups of any size are aggregated where their rows lie, and the
    inverses are worked out by the tasks.
    """
    names = [(f, i) for i, f in enumerate(FEATURES)]
    whole = profiles.agg(*(_median(f).alias(f) for f in FEATURES)).first()
    if whole[0] is None:
        whole = dict(zip(FEATURES, profile(None)))
    middle = profiles.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(_median(f).alias(f"m_{f}") for f in FEATURES))
    middle = middle.select(group, "n", *(F.greatest(F.lit(float(CENTRE_BOUNDS[i][0])), F.least(F.lit(float(CENTRE_BOUNDS[i][1])), _leaning(f"m_{f}", whole[f]))).alias(f"m_{f}") for f, i in names))
    off = _with_group(profiles.select(group, *FEATURES), middle, group, n_groups)
    spread = off.groupBy(group).agg(*(_median(F.abs(F.col(f) - F.col(f"m_{f}"))).alias(f"s_{f}") for f in FEATURES))
    spread = spread.select(group, *(F.greatest(F.lit(SCALES[i]), F.least(F.lit(SCALE_RANGE * SCALES[i]), 1.4826 * F.col(f"s_{f}"))).alias(f"s_{f}") for f, i in names))
    scaled = _with_group(off, spread, group, n_groups)
    cut = {f: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}"))) for f in FEATURES}
    products = [F.avg(cut[a] * cut[b]) for a in FEATURES for b in FEATURES]
    gathered = lambda letter: F.array(*(F.first(f"{letter}_{f}") for f in FEATURES))
    moments = scaled.groupBy(group).agg(gathered("m").alias("centre"), gathered("s").alias("scale"), F.array(*products).alias("inverse"))

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(inverse=[_inverse(np.array(c)).tolist() for c in frame["inverse"]])

    return on_workers(moments).mapInPandas(invert, moments.schema)


def _inverse(products: np.ndarray) -> np.ndarray:
    """Inverse of the correlation behind the averaged products of deviations, as a flat array."""
    c = products.reshape(len(FEATURES), -1)
    wide = np.sqrt(np.maximum(np.diag(c), 1e-9))
    return np.linalg.inv((1 - SHRINK) * c / np.outer(wide, wide) + SHRINK * np.eye(len(c))).ravel()


def page_scores(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """``key``, ``distance``, ``direction`` (a cosine) and ``FEATURES`` of every document.

    Whole texts are measured; null, empty and blank texts get the features of
    an empty page. Repeated rows each come out, rows with equal text and
    language with equal scores. A null language and an empty one are each a
    language of their own. An empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "stuffing")
    # a copy under fixed names, so that other columns of any name do no harm
    own = F.when(F.col(language).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(language)))
    source = documents.select(F.col(key).alias("key"), own.alias("language"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    profiles = scratch.write(profile_texts(source, ["key", "language", "hash"]), "profiles")
    distinct = scratch.write(profiles.select("language", "hash", *FEATURES).dropDuplicates(["language", "hash"]).drop("hash"), "distinct")
    n_languages = distinct.select("language").distinct().count()
    scatter = scratch.write(robust_scatter(distinct, "language", n_languages), "scatter")
    scored = _with_group(profiles, scatter, "language", n_languages)
    n = range(len(FEATURES))
    scored = scored.withColumn("z", F.array(*((F.col(f) - F.col("centre")[i]) / F.col("scale")[i] for i, f in enumerate(FEATURES))))
    distance = F.sqrt(F.greatest(sum(F.col("z")[i] * F.col("z")[j] * F.col("inverse")[i * len(FEATURES) + j] for i in n for j in n), F.lit(0.0)))
    along = sum(SPAM_DIRECTION[i] * F.col("z")[i] for i in n) / math.sqrt(len(FEATURES))
    direction = along / F.sqrt(F.greatest(sum(F.col("z")[i] * F.col("z")[i] for i in n), F.lit(1e-12)))
    return scored.select(F.col("key").alias(key), distance.alias("distance"), direction.alias("direction"), *FEATURES)


def stuffed_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """The rows of ``page_scores`` that are spam: outliers in the spam direction. Null, empty and blank texts never are."""
    return page_scores(documents, key, text, language).where((F.col("distance") > MIN_DISTANCE) & (F.col("direction") > MIN_DIRECTION))
