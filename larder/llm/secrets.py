"""Secret scan: patterns propose candidates, a random forest removes the false ones.

The forest sees the length of a candidate, transitions between kinds of characters, how much of it a dictionary covers, words
of its path, and the words around it. The dictionary holds common words and those that stand in most of the texts. The forest is trained from labelled findings; where none are at hand, findings that rules settle
either way (formats of known issuers, placeholders, plain numbers) serve as labels, and the forest decides the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import durable, small_or_shuffled, spare, unit_hash

# Kind and pattern of proposals; the group `secret` is the candidate. Earlier kinds win over later ones.
PATTERNS = [
    ("aws_key", r"(?<![A-Za-z0-9])(?P<secret>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])(?P<secret>gh[pousr]_[A-Za-z0-9]{36,251})(?![A-Za-z0-9])"),
    ("slack_token", r"(?<![A-Za-z0-9])(?P<secret>xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("google_key", r"(?<![A-Za-z0-9])(?P<secret>AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])"),
    ("web_token", r"(?<![A-Za-z0-9_-])(?P<secret>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"),
    # all up to the END line; where none comes before the next marker, header lines and runs of base64 of 16 or more that are no
    # word (a digit, a sign, or capitals as no word has them), at last a padded shorter one
    ("private_key", r"(?P<secret>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
                    r"|(?:[ \t]*+\r?\n[ \t]*+(?:Proc-Type|DEK-Info|Key-Info|MIC-Info|Content-Domain|X-[A-Za-z0-9-]++):[^\r\n]*+)*+"
                    r"(?:(?:(?:\s|\\[nr])*+(?=[A-Za-z]*+[0-9+/]|[a-z]++[A-Z]|[A-Z][a-z]*+[A-Z]++[a-z])[A-Za-z0-9+/]{16,}+={0,2}+)++"
                    r"(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{1,15}+={1,2}+)?(?:[ \t]*+\r?\n)?)?))"),
    ("assigned", r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?[ \t]{0,8}(?:=|:=|:)[ \t]{0,8}[\"']?(?P<secret>[^\s\"'<>,;]{6,}+)"),
    ("token", r"(?<![A-Za-z0-9_+/=-])(?P<secret>(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+)"),
]
ISSUED = {"aws_key", "github_token", "slack_token", "google_key", "web_token", "private_key"}
# Words that speak for a secret, for something else, for a placeholder; words of a path; common words.
FOR = set("password passwd pwd secret token key apikey api auth credential credentials bearer login private access".split())
AGAINST = set("commit sha sha1 sha256 md5 hash checksum digest revision uuid guid id isbn doi version order card build".split())
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "yourkey", "your_", "xxxx", "todo", "redacted", "12345678", "abcdefgh")
PATHS = ("test", "example", "doc", "lock", "min", "config", "env", "src")
DICTIONARY = frozenset("""the and for with from this that have not you are was but all can use your name user data file path test code
line text word page site link image value field table index order group admin guest default master local remote server client
service system public private change example sample dummy placeholder hello world password secret token key login account access
black white green house water light night river stone horse dragon monkey summer winter spring autumn sunday monday love""".split())  # fmt: skip
#: Words learned from the texts beside DICTIONARY: the most frequent ones by number of texts, within these lengths, in so many texts.
LEARNED_WORDS, LEARNED_FROM, LEARNED_TO, LEARNED_TEXTS = 20_000, 4, 14, 3
#: Code points before and after a candidate whose words are read; labelled findings that are trained on.
NEARBY, TRAIN_ROWS, TREES, DEPTH, KEEP_FROM = 40, 4000, 40, 6, 0.5
_COMPILED = [(k, re.compile(p)) for k, p in PATTERNS]
_WORD = re.compile(r"[^\W\d_]+|\d+")
_LONGEST = max(LEARNED_TO, *map(len, DICTIONARY))


def propose(text: str | None) -> list[tuple[int, int, str]]:
    """start, end, kind of candidates; where two overlap the earlier pattern wins, then the earlier place."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _COMPILED:
        old, at, more = taken, 0, []
        for m in pattern.finditer(text or ""):
            start, end = m.span("secret")
            while at < len(old) and old[at][1] <= start:
                at += 1
            if at == len(old) or end <= old[at][0]:
                more.append((start, end, kind))
        taken = sorted(old + more)
    return taken


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = LEARNED_WORDS, in_texts: int = LEARNED_TEXTS) -> frozenset[str]:
    """DICTIONARY and the words a-z that stand in most texts, equal ones in alphabetical order; null texts and empty tables add none.

    All texts are counted. The counts' powers of two say first which words can be among the most frequent, so that what
    is sorted and comes to the driver does not grow with the number of tasks.
    """
    long_enough = f"[^a-z]+|(?<![a-z])(?:[a-z]{{1,{LEARNED_FROM - 1}}}|[a-z]{{{LEARNED_TO + 1},}})(?![a-z])"
    words = F.array_distinct(F.split(F.lower(F.coalesce(text_col, F.lit(""))), long_enough))
    seen = docs.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("texts"))
    seen = durable(seen.where(F.col("texts") >= in_texts))
    power = F.floor(F.log2("texts")).cast("int")
    least, held = 0, 0
    for level, n in sorted(seen.groupBy(power.alias("power")).count().collect(), reverse=True):  # 64 rows at most
        least, held = 2**level, held + n
        if held >= most:
            break
    top = seen.where(F.col("texts") >= least).orderBy(F.desc("texts"), "word").limit(most)
    return DICTIONARY | {r.word for r in top.select("word").collect()}


def covered(value: str, words: frozenset[str] = DICTIONARY) -> float:
    """Part of a candidate that words of the dictionary make up, taken greedily from the left."""
    lowered, at, hits = value.lower(), 0, 0
    while at < len(lowered):
        size = next((n for n in range(min(_LONGEST, len(lowered) - at), 2, -1) if lowered[at:at + n] in words), 0)
        hits += size
        at += size or 1
    return hits / max(1, len(lowered))


def _kind_of(c: str) -> str:
    return "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "d" if c.isdigit() else "o"


FEATURES = ["length", "entropy", "digits", "upper", "lower", "hexadecimal", "distinct", "same", *(a + b for a in "uldo" for b in "uldo"),
            "dictionary", "assigned", "quoted", "for", "against", "placeholder", *(f"path_{p}" for p in PATHS)]


def describe(text: str, start: int, end: int, path: str | None, words: frozenset[str] = DICTIONARY) -> list[float]:
    value, n = text[start:end], end - start
    kinds = [_kind_of(c) for c in value]
    counts, pairs = Counter(value), Counter(zip(kinds, kinds[1:]))
    before, after = text[max(0, start - NEARBY):start], text[end:end + NEARBY]
    near = [w.lower() for w in _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]]
    lowered, where = value.lower(), (path or "").lower()
    return [
        math.log(n), -sum(c / n * math.log2(c / n) for c in counts.values()), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n, len(counts) / n, sum(a == b for a, b in zip(value, value[1:])) / n,
        *(pairs[a, b] / max(1, n - 1) for a in "uldo" for b in "uldo"),
        covered(value, words), float(before.rstrip(" \t\"'")[-1:] in ("=", ":")), float(before[-1:] in ("'", '"')),
        float(any(w in FOR for w in near)), float(any(w in AGAINST for w in near)), float(any(p in lowered for p in PLACEHOLDERS)),
        *(float(p in where) for p in PATHS),
    ]


def settled(kind: str, value: str, described: list[float]) -> float | None:
    """1 or 0 where rules settle a finding, else None."""
    f = dict(zip(FEATURES, described, strict=True))
    if f["placeholder"] or f["same"] > 0.5 or f["dictionary"] > 0.8 or f["digits"] == 1.0 and kind == "token" or f["against"] and not f["for"]:
        return 0.0
    if kind in ISSUED or kind == "assigned" and (f["entropy"] > 3.0 or f["digits"] > 0):
        return 1.0
    return None


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate: id, text_key (hash of the text), start, end (code points), kind, value, features, label (null: not settled)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, text_col))  # at most LEARNED_WORDS words

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = known.value
        for f in frames:
            out = []
            for place, (text, path) in enumerate(zip(f["text"], f["path"], strict=True)):
                for start, end, kind in propose(text):
                    features = describe(text, start, end, path, words)
                    out.append((place, start, end, kind, text[start:end], features, settled(kind, text[start:end], features)))
            found = pd.DataFrame(out, columns=["place", "start", "end", "kind", "value", "features", "label"]).astype({"label": "Float64"})
            at = found["place"].to_numpy(int)
            yield found.drop(columns="place").assign(id=f["id"].to_numpy()[at], text_key=f["text_key"].to_numpy()[at])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    # the id travels as text, which keeps large numbers exact beside nulls
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"), path.alias("path"))
    schema = "id string, text_key long, start long, end long, kind string, value string, features array<double>, label double"
    found = narrow.mapInPandas(run, schema)
    return found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """labelled: features and label of findings. About train_rows of either label, chosen by a hash; None if a label is missing."""
    counts = {r["label"]: r["count"] for r in labelled.where("label IN (0, 1)").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    chance = F.when(F.col("label") == 1, min(1.0, train_rows / counts[1.0])).otherwise(min(1.0, train_rows / counts[0.0]))
    sample = labelled.where("label IN (0, 1)").where(unit_hash("value", "text_key", "start") < chance)
    weight = F.when(F.col("label") == 1, 1 / counts[1.0]).otherwise(1 / counts[0.0]) * sum(counts.values()) / 2
    vectors = sample.select(array_to_vector("features").alias("features"), "label", weight.alias("weight")).repartition(8)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, weightCol="weight").fit(vectors)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         keep_from: float = KEEP_FROM) -> DataFrame:
    """Findings that the forest keeps: id, text_key, start, end (code points, end exclusive), kind, value, score.

    labelled: findings with features and label, as findings() gives them; without it the findings that rules settle are used. If
    a label is missing, rules alone decide and unsettled findings score one half. Null and empty texts have none; repeated
    rows give repeated findings; a null id stays; an empty table gives an empty result; a column named like an output does no harm.
    """
    found = durable(findings(docs, id_col, text_col, path_col))
    model = train(found if labelled is None else labelled)
    if model is None:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.5)))
    else:
        vectors = found.withColumn("vector", array_to_vector("features"))
        model.setFeaturesCol("vector").setRawPredictionCol("raw").setProbabilityCol("chances").setPredictionCol("predicted")
        scored = model.transform(vectors).withColumn("score", vector_to_array("chances")[1])
    return scored.where(F.col("score") >= keep_from).select("id", "text_key", "start", "end", "kind", "value", F.round("score", 6).alias("score"))


@F.pandas_udf(T.StringType())
def _blanked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text, found):
        if found is None or len(found) == 0:
            return text
        out, at = [], 0
        for s in sorted(found, key=lambda s: s["start"]):
            out += [text[at:s["start"]], f"[{s['kind']}]"]
            at = s["end"]
        return "".join([*out, text[at:]])

    return pd.Series([one(t, f) for t, f in zip(texts, spans, strict=True)], dtype=object)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every kept finding replaced by its kind in brackets; length_col, if given, follows. Columns and rows as they are.

    Null and empty texts and null ids stay; rows of the same id and text are changed alike; an empty table gives an empty result.
    """
    own_id, own_key, own_spans = spare(docs, "_id", "_key", "_spans")
    kept = scan(docs, None, id_col, text_col, path_col).select("id", "text_key", "start", "end", "kind").distinct()
    spans = kept.groupBy(F.col("id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.collect_list(F.struct("start", "end", "kind")).alias(own_spans))
    same = docs[id_col].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text_col]) == F.col(own_key))
    joined = docs.join(small_or_shuffled(spans, F.size(own_spans)), same, "left")
    hit = F.col(own_spans).isNotNull()
    text: Column = F.when(hit, _blanked(F.when(hit, F.col(text_col)), F.col(own_spans))).otherwise(F.col(text_col))
    changed = joined.withColumn(text_col, text)
    if length_col:
        changed = changed.withColumn(length_col, F.when(hit, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return changed.select(*docs.columns)
