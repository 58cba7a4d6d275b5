"""Secret scans: candidate strings, judged by a random forest that removes false positives.

Candidates are long runs of key characters and, whatever their length and characters,
values given to a name with a secret word in it (name = value, name: value, name is value)
and passwords in addresses (scheme://user:password@).  They may overlap; each is judged.
The forest sees their length, character transitions under counts of the whole corpus, how
far common letter groups of the corpus (a dictionary below the word) cover them, signs of
a path around them, and the neighbouring words.  It is trained on labelled findings; the registered query plants a
bounded number of them, secrets and look-alikes, between words of the corpus.
"""

from __future__ import annotations

import base64
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quitanda.llm.frames import durable, given_back, row_key, size_checked
from quitanda.llm.ngrams import gram_counts
from quitanda.llm.words import STEP, windows

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{16,})*")
#: Names with = in front of a run; the = at the end of a run are padding.
FRONT = re.compile(r"(?:[A-Za-z0-9+/_.-]++=)+(?!=|$)")
#: A name and the sign that gives it a value; a value in quotes or without; a password before the host of an address.
HEAD = re.compile(r"(?<![\w.-])([\w.-]++)[\"'`\])]*+(?:\s*+[=:]{1,3}+>?|\s++is(?=\s))\s*+")
QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)++)"|\'((?:[^\'\\\n]|\\.)++)\'|`([^`\n]++)`')
UNQUOTED, IN_QUERY = re.compile(r"[\"'`]?(\S+)"), re.compile(r"([^\s&#\"'<>]+)")
ADDRESS = re.compile(r"://[^\s:/@?#\"'<>]*+:([^\s/?#\"'<>]+)@")
CLOSING = ",;)]}>.'\"`"
MASK = "[SECRET]"
CONTEXT_CHARS = 64
#: Labelled findings that the query plants, and documents whose words surround them.
FINDINGS, CONTEXT_DOCUMENTS, CONTEXT_WORDS = 4000, 500, 5000
TREES, DEPTH, SEED = 40, 8, 11
CUTOFF = 0.5
TRANSITIONS, GROUPS = 1 << 16, 1 << 16
FEATURES = (
    "length", "entropy", "class_changes", "transition", "dictionary", "digits", "capitals", "hexadecimal",
    "path_marks", "assigned", "secret_words", "reference_words", "known_start", "named", "in_address", "symbols", "blanks",
)

#: Words beside secrets, words beside harmless digests and names, starts of issued keys.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "bearer", "credential", "access", "private")
REFERENCE_WORDS = ("commit", "sha", "md5", "checksum", "digest", "etag", "uuid", "hash", "id", "revision", "version", "file", "image", "ref", "order")
KNOWN_STARTS = ("AKIA", "ghp_", "gho_", "ghs_", "sk-", "sk_", "pk_", "xox", "eyJ", "AIza", "glpat-")

_WORD = re.compile(r"[A-Za-z0-9]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAME_BEFORE = re.compile(r"([\w.-]+)[\"'`\])]*(?:\s*[=:]{1,3}>?|\s+is)\s*[\"'`]?$")
_USER_BEFORE = re.compile(r"://[^\s:/@?#]*:$")


def secret_name(name: str) -> bool:
    """Whether a part of a name, as in db_password, dbPassword or DBPASSWORD, is a secret word or ends in a long one."""
    long = tuple(w for w in SECRET_WORDS if len(w) > 4)
    parts = [w.lower() for w in _PART.findall(name)]
    return any(w in SECRET_WORDS or w.removesuffix("s") in SECRET_WORDS or w.endswith(long) for w in parts)


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Distinct (start, end) of all candidates of a text, in order; they may overlap.

    Of name=run the run is a candidate, however short, and the name if it is a run itself.
    A value without quotes ends at a blank, less closing marks, and in the query of an
    address at the next parameter; a password in an address has no '/', '?' or '#'.
    """
    spans = set()
    for m in CANDIDATE.finditer(text):
        front = FRONT.match(m[0])
        if front:
            spans.update((m.start() + x.start(), m.start() + x.end()) for x in re.finditer("[^=]+", front[0]) if CANDIDATE.fullmatch(x[0]))
        spans.add((m.start() + (front.end() if front else 0), m.end()))
    spans.update(m.span(1) for m in ADDRESS.finditer(text))
    for head in HEAD.finditer(text):
        if not secret_name(head[1]):
            continue
        queried = text[max(0, head.start() - 1) : head.start()] in ("?", "&")
        value = (not queried and QUOTED.match(text, head.end())) or (IN_QUERY if queried else UNQUOTED).match(text, head.end())
        if value:
            a, b = value.span(value.lastindex)
            if value.re is UNQUOTED:
                b = a + len(value[1].rstrip(CLOSING))
            if a < b:
                spans.add((a, b))
    return sorted(spans)


def corpus_grams(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bytes (the lower buckets) and hashed groups of four letters (the upper ones) of texts."""
    pairs = (raw[:-1].astype(np.int64) << 8) | raw[1:] if len(raw) > 1 else np.zeros(0, np.int64)
    at = [np.arange(len(pairs))]
    found = [pairs]
    letter = np.isin(raw | 32, np.arange(97, 123)) & (raw < 128)
    for lo, hi in windows(raw, bounds):
        ok = letter[lo : max(lo, min(hi, len(raw) - 3))].copy()
        for k in range(1, 4):
            ok &= letter[lo + k : lo + k + len(ok)]
        place = np.flatnonzero(ok) + lo
        found.append(TRANSITIONS + letter_group([raw[place + k] for k in range(4)]))
        at.append(place)
    order = np.argsort(np.concatenate(at), kind="stable")
    return np.concatenate(found)[order], np.searchsorted(np.concatenate(at)[order], bounds)


def letter_group(letters: list) -> np.ndarray:
    total = np.zeros(np.shape(letters[0]), np.uint64)
    for x in letters:
        total = total * STEP + (np.asarray(x, np.uint64) | np.uint64(32))
    return ((total * STEP) >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class CorpusTables:
    """Of fixed size: log probability of each pair of bytes, and which letter groups are common."""

    transition: np.ndarray
    common: np.ndarray


def corpus_tables(docs: DataFrame, text: str = "text") -> CorpusTables:
    """Count byte pairs and letter groups over all texts."""
    rows = docs.select(F.col(text).alias("text"), F.lit(False).alias("trusted"))
    counts = np.zeros(TRANSITIONS + GROUPS)
    for r in gram_counts(rows, "text", "trusted", corpus_grams, TRANSITIONS + GROUPS).collect():
        counts[r["bucket"]] = r["raw"]
    pairs = counts[:TRANSITIONS].reshape(256, 256) + 1
    groups = counts[TRANSITIONS:]
    return CorpusTables(np.log(pairs / pairs.sum(1, keepdims=True)), groups > groups.mean())


def kind_of(char: str) -> int:
    return 0 if char.islower() else 1 if char.isupper() else 2 if char.isdigit() else 3


def features_of(candidate: str, before: str, after: str, tables: CorpusTables) -> list[float]:
    """The values of FEATURES for a candidate between two contexts."""
    raw = np.frombuffer(candidate.encode(), np.uint8)
    shares = np.bincount(raw) / len(raw)
    shares = shares[shares > 0]
    kinds = [kind_of(c) for c in candidate]
    covered = np.zeros(len(raw), bool)
    letters = np.isin(raw | 32, np.arange(97, 123))
    four = np.flatnonzero(letters[:-3] & letters[1:-2] & letters[2:-1] & letters[3:])
    if len(four):
        known = four[tables.common[letter_group([raw[four + k] for k in range(4)])]]
        for k in range(4):
            covered[known + k] = True
    left, right = before.split(" ")[-1], re.split(r"\s", after, maxsplit=1)[0]
    near = {w.lower() for w in _WORD.findall(before)[-3:] + _WORD.findall(after)[:1]}
    ahead = before.rstrip(" \"'`")
    name = _NAME_BEFORE.search(before)
    return [
        float(np.log2(len(raw))),
        float(-(shares * np.log2(shares)).sum()),
        sum(a != b for a, b in pairwise(kinds)) / len(raw),
        float(tables.transition[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0,
        float(covered.mean()),
        kinds.count(2) / len(raw),
        kinds.count(1) / len(raw),
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        float((left + right).count("/") + (left + right).count(".") + candidate.count("/") + 3 * ("://" in left)),
        float(ahead.endswith(("=", ":"))),
        float(any(w in near for w in SECRET_WORDS)),
        float(any(w in near for w in REFERENCE_WORDS)),
        float(candidate.startswith(KNOWN_STARTS)),
        float(name is not None and secret_name(name[1])),
        float(_USER_BEFORE.search(before) is not None and after.startswith("@")),
        kinds.count(3) / len(kinds),
        float(any(c.isspace() for c in candidate)),
    ]


def candidates(docs: DataFrame, tables: CorpusTables, text: str = "text") -> DataFrame:
    """`docs` with one row per candidate: `start`, `length` (code points) and `values`, its features."""

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("values", pa.list_(pa.float64()))]))

    def found_in(t: str) -> list[dict]:
        near = ((a, b, t[max(0, a - CONTEXT_CHARS) : a], t[b : b + CONTEXT_CHARS]) for a, b in candidate_spans(t))
        return [{"start": a, "length": b - a, "values": features_of(t[a:b], before, after, tables)} for a, b, before, after in near]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            slices = (texts.slice(start, 256).to_pylist() for start in range(0, len(texts), 256))
            parts = [pa.array([found_in(t or "") for t in some], kind) for some in slices]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    @F.arrow_udf("array<struct<start: bigint, length: bigint, values: array<double>>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from given_back(run)(batches)

    rows = docs.drop("start", "length", "values", "_c").withColumn("_c", F.explode(scan(F.col(text).cast("string"))))
    return rows.select("*", "_c.*").drop("_c")


def _random_text(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def _planted_password(rng: random.Random, words: list[str]) -> str:
    """A short secret: mixed characters, or a word with digits and marks in it."""
    marks = "!@#$%^&*~?+-_"
    if rng.random() < 0.5:
        keys = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789" + marks[: rng.choice((0, 13))]
        return _random_text(rng, keys, rng.randint(6, 24))
    word = rng.choice(words)[:10]
    word = word.capitalize() if rng.random() < 0.6 else word
    if rng.random() < 0.7:
        word = word.translate(str.maketrans("oaeis", "04315"))
    return word + _random_text(rng, marks, rng.randint(0, 2)) + _random_text(rng, "0123456789", rng.randint(1, 5)) + _random_text(rng, marks, rng.randint(0, 2))


def _planted_values(rng: random.Random, words: list[str], names: tuple[str, ...], label: int) -> str:
    """Text with a short secret given to a name or in an address, or with a harmless value there."""
    name, word = rng.choice((*names, "passwd", "pwd", "dbPassword", "DB_PASSWORD")), lambda: rng.choice(words)
    if label:
        value = _planted_password(rng, words)
        if rng.random() < 0.3:
            return f"{rng.choice(('postgres', 'https', 'mysql', 'redis', 'ftp'))}://{rng.choice((word().lower(), 'user', ''))}:{value.replace('?', '.').replace('#', '.')}@{word().lower()}.example.com/{word()}"
        if rng.random() < 0.1:
            return f"https://{word().lower()}.example.com/{word()}?{name}={value.replace('&', '.').replace('#', '.')}&{word()}={word()}"
        return rng.choice(("{} = {}", "{}={}", "{}: {}", '{} = "{}"', "{}='{}'", '"{}": "{}"', "{} is {}")).format(name, value)
    value = rng.choice((
        word, word, lambda: f"{word()} {word()}", lambda: word().capitalize(), lambda: str(rng.randint(0, 9999)),
        lambda: f"{word().lower()}({rng.choice(('', word().lower()))})", lambda: f"{word().lower()}.{word().lower()}", lambda: f"${{{word().upper()}}}", lambda: f"<{word().lower()}>",
        lambda: f"/{word().lower()}/{word().lower()}", lambda: rng.choice("*x.-") * rng.randint(3, 12), lambda: rng.choice(("None", "null", "true", "false", "required", "public")),
    ))()
    kind = rng.random()
    if kind < 0.1:
        return f"http://{word().lower()}.example.com:{rng.randint(80, 9999)}/{word()} at {word()}@{word().lower()}.com"
    if kind < 0.25:
        return f'{name}: "{" ".join(word() for _ in range(rng.randint(2, 9)))}"'
    return rng.choice(("{} = {}", "{}={}", "{}: {}", '{} = "{}"', '"{}": "{}"', "{} is {}")).format(name, value)


def plant_findings(words: list[str], n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, candidate, after, is_secret): all candidates of n texts of the given words.

    Half are secrets of several makes, assigned to a name or bare; the others are strings of
    the same looks in harmless places, and long words, numbers, paths and addresses.  A
    third are short: passwords of 6 characters and more beside a name or in an address, and
    words, numbers and code in their places.
    """
    rng, words = random.Random(seed), words or ["text"]
    hexes, keys = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    secrets = (
        lambda: _random_text(rng, hexes, rng.choice((32, 40, 64))),
        lambda: _random_text(rng, keys, rng.randint(20, 64)),
        lambda: base64.b64encode(rng.randbytes(rng.randint(18, 48))).decode(),
        lambda: rng.choice(KNOWN_STARTS) + _random_text(rng, keys, rng.randint(16, 40)),
    )
    names = ("token", "secret", "password", "api_key", "auth_token", "access_key", "private_key", "client_secret", "key")
    harmless = (
        lambda: (rng.choice(("commit ", "sha ", "md5: ", "checksum = ", "digest ", "etag: ", "revision ")), _random_text(rng, hexes, rng.choice((32, 40, 64)))),
        lambda: (rng.choice(("id ", "uuid: ", "order ", "ref ")), str(uuid.UUID(int=rng.getrandbits(128)))),
        lambda: (rng.choice(("", "https://www.example.com/", "/usr/share/", "see ")), "/".join(_random_text(rng, keys, 4) if rng.random() < 0.2 else rng.choice(words) for _ in range(5)) + "/index"),
        lambda: ("", "".join(rng.choice(words) for _ in range(5))),
        lambda: ("", "_".join(rng.choice(words).lower() for _ in range(4))),
        lambda: (rng.choice(("", "card ", "number ")), _random_text(rng, "0123456789", rng.randint(16, 20))),
        lambda: ("", rng.choice("=-_") * rng.randint(16, 60)),
        lambda: ("data:image/png;base64,", base64.b64encode(some(12).encode()).decode()),
        lambda: (rng.choice(names) + rng.choice((" ", ": ", " = ")), "".join(rng.choice(words) for _ in range(5))),
    )
    rows = []
    for i in range(n):
        label, before = 1 - i % 2, f"{some(3)} "
        if rng.random() < 1 / 3:
            lead, body, close = "", _planted_values(rng, words, names, label), ""
        elif label:
            body = rng.choice(secrets)()
            lead = rng.choice(names) + rng.choice((" = ", "=", ": ", ' = "', '="', " is "))
            lead = lead.upper() if rng.random() < 0.2 else lead
            lead = "" if rng.random() < 0.3 else lead
            close = '"' if lead.endswith('"') else rng.choice(("", '"', ","))
        else:
            lead, body = rng.choice(harmless)()
            close = rng.choice(("", '"'))
        text, end = f"{before}{lead}{body}{close} {some(2)}", len(before) + len(lead) + len(body)
        # Cut as a scan cuts it, so that training sees what it will be asked about.
        inside = [(a, b) for a, b in candidate_spans(text) if a < end and b > len(before) + (len(lead) if label else 0)]
        rows.extend((text[:a], text[a:b], text[b:], label) for a, b in inside)
    return rows


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]], tables: CorpusTables) -> RandomForestClassificationModel:
    """A random forest on labelled findings (before, candidate, after, is_secret)."""
    rows = [(features_of(c, before[-CONTEXT_CHARS:], after[:CONTEXT_CHARS], tables), float(label)) for before, c, after, label in findings]
    data = spark.createDataFrame(rows, "values array<double>, label double").coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(data.select(array_to_vector("values").alias("features"), "label"))


def context_words(docs: DataFrame, text: str = "text", documents: int = CONTEXT_DOCUMENTS, words: int = CONTEXT_WORDS) -> list[str]:
    """Distinct words of a bounded sample of documents; sample and words are chosen by hashes."""
    hashed = docs.filter(F.length(text) > 0).select(F.xxhash64(text).alias("h"))
    # Only hashes are sorted; texts come after them, all that share a hash up to the last one chosen.
    last = hashed.orderBy("h").limit(documents).agg(F.max("h")).first()[0]
    if last is None:
        return []
    chosen = docs.filter((F.length(text) > 0) & (F.xxhash64(text) <= last)).select(F.col(text).alias("t")).distinct()
    found = chosen.select(F.explode(F.split("t", r"\s+")).alias("w")).filter(F.col("w").rlike("^[A-Za-z]{2,15}$"))
    return sorted(r["w"] for r in found.distinct().orderBy(F.xxhash64("w")).limit(words).collect())


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, tables: CorpusTables, text: str = "text") -> DataFrame:
    """`docs` without its text, one row per candidate: start, length, probability, is_secret.

    A null or empty text has no candidates, repeated rows have theirs each, an empty table
    gives no rows, and columns of the names above are replaced.
    """
    rows = candidates(docs.drop("features", "rawPrediction", "probability", "prediction", "is_secret"), tables, text)
    judged = model.transform(rows.drop(*([text] if text != "_text" else [])).withColumn("features", array_to_vector("values")))
    judged = judged.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    judged = judged.withColumn("is_secret", F.col("probability") >= CUTOFF)
    return judged.drop("values", "features", "rawPrediction", "prediction")


def fit(docs: DataFrame, text: str = "text") -> tuple[RandomForestClassificationModel, CorpusTables]:
    """Tables of the corpus and a forest trained on findings planted among its words."""
    tables = corpus_tables(docs, text)
    return train(docs.sparkSession, plant_findings(context_words(docs, text)), tables), tables


def masked(text: Column, spans: Column) -> Column:
    """A text with the spans (start, length) replaced by MASK; spans that overlap are one."""

    def step(done: Column, s: Column) -> Column:
        between = F.substr(text, (done.at + 1).cast("int"), (s.start - done.at).cast("int"))
        out = F.when(s.start >= done.at, F.concat(done.out, between, F.lit(MASK))).otherwise(done.out)
        return F.struct(out.alias("out"), F.greatest(done.at, s.start + s.length).alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.array_sort(spans), first, step, lambda done: F.concat(done.out, F.substr(text, (done.at + 1).cast("int"))))


def mask_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every secret in `text` replaced by MASK; all rows and columns stay.

    A null text stays null, repeated rows are masked alike, an empty table gives no rows.
    Columns of the operator's own names are not touched, but for `_key` and `_spans`, which must be free.
    """
    model, tables = fit(docs, text)
    keyed = docs.withColumn("_key", row_key(doc_id, text))
    found = scan_secrets(keyed.select("_key", text), model, tables, text).filter("is_secret")
    spans = durable(found.groupBy("_key").agg(F.collect_set(F.struct("start", "length")).alias("_spans")))
    rows = keyed.join(size_checked(spans), "_key", "left")
    return rows.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("_spans")))).select(*docs.columns)


def op9_secret_scan(spark, folder: str) -> DataFrame:
    """Every candidate of every document with its probability and verdict."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model, tables = fit(docs)
    return scan_secrets(docs, model, tables)
