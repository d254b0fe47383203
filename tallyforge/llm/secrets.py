"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are key-like strings of any document. Their features: kind, length, transitions between
classes of characters, letter pairs, entropy, how much of the string a dictionary covers (longest
words first), whether it looks like a path, and the words at each place beside it. The forest (Spark
ML) is trained on labelled findings; where none are given, on `planted` ones: findings written down
with their label, not labelled by a rule over their features. The labelled sample is bounded by
`most_labelled`; every document is scanned.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small_batches, table

PRIVATE_KEY = r"PRIVATE KEY(?: BLOCK)?-----"
#: A key runs to its END line, headers included; without one, over the lines that look like a key's.
KEY = (
    rf"(?P<private_key>-----BEGIN [A-Z ]*{PRIVATE_KEY}(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*{PRIVATE_KEY}"
    r"|(?:\s+(?:(?:Proc-Type|DEK-Info):[^\r\n]*|[A-Za-z0-9+/]{32,}={0,2}(?:\s+[A-Za-z0-9+/]{1,31}={1,2})?))*))"
    r"|(?<![A-Za-z0-9])(?P<access_key>(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<prefixed>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|sk-[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)"
)
#: A name is read as a whole, however long, if it holds one of these words.
NAMED = (
    r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]*(?ai:pass_?word|passwd|pass_?phrase|pwd|secret|token|auth|credential"
    r"|(?:api|access|account|shared|private|encryption|signing|master|storage|client|service|session)_?key))[A-Za-z0-9_]++"
)
#: What stands between a name and its value: signs of assignment with any blanks, quotes that may be escaped.
ASSIGNED = r"(?:\\?[\"'])?\s*+(?::=|=>|=|:)\s*+(?:\\?[\"'])?"
HEX = r"(?<![A-Za-z0-9])(?P<hex>(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,})(?![A-Za-z0-9])"
#: Kinds of candidates, the first that fits counts. Values are taken whole, however long.
CANDIDATE = re.compile(
    rf"{KEY}|{NAMED}{ASSIGNED}(?P<assigned>[^\s\"'<>,;|]{{4,}})|<{NAMED}>(?P<assigned_>[^\s\"'<>,;|]{{4,}})|{HEX}"
    r"|(?<![A-Za-z0-9+/=_-])(?P<mixed>(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2})"
    r"|(?P<address>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,200}\.[A-Za-z]{2,10})"
    r"|(?P<link>https?://[^\s\"'<>]{4,})",
)
#: Inside a link: values end with their parameter or part of the path; the password before the host is a value too.
IN_LINK = re.compile(
    rf"{KEY}|(?<=://)[^\s/@:?#]*:(?P<assigned>[^\s/@?#]{{4,}})(?=@)"
    rf"|{NAMED}(?:=|:|%3[ADad])(?P<assigned_>[^\s&#;,|]{{4,}})|{HEX}"
    r"|(?<==)(?P<mixed>(?=[A-Za-z+/_%-]*[0-9])(?=[a-z0-9+/_%-]*[A-Z])(?=[A-Z0-9+/_%-]*[a-z])[A-Za-z0-9+/_%-]{24,}={0,2})"
    r"|(?<![A-Za-z0-9+_%-])(?P<mixed_>(?=[A-Za-z+_%-]*[0-9])(?=[a-z0-9+_%-]*[A-Z])(?=[A-Z0-9+_%-]*[a-z])[A-Za-z0-9+_%-]{24,}={0,2})",
)
KNOWN, SCHEME = re.compile(KEY), re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
#: Only a text with a naming word, an address, a link or a long word with a digit or a known prefix can hold a candidate.
NAMES = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
PREFIXED = re.compile(r"gh[pousr]_|github_pat|sk[-_]|xox[abprs]-|AIza|glpat-|eyJ|A(?:KIA|SIA|GPA|IDA|ROA)")
LONG_WORD, DIGIT = 15, re.compile(r"[0-9]").search


def may_hold(text: str) -> bool:
    """Whether a candidate may stand in a text: plain substring tests, so that few texts meet the patterns. True wherever CANDIDATE matches."""
    if "@" in text or "://" in text or "PRIVATE KEY" in text:
        return True
    low = text.lower()
    if any(x in low for x in NAMES):
        return True
    return any(len(w) >= LONG_WORD and (DIGIT(w) or PREFIXED.search(w)) for w in text.split())


def matches(text: str) -> Iterator[tuple[str, int, int, str, str]]:
    """Kind, begin, end, and what stands before and after, of each candidate by place; none overlap.

    A value with a link is searched for the other kinds; only if none is inside, it is a candidate as a whole.
    """
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup.rstrip("_")
        at, end = m.span(m.lastgroup)
        inside = False
        if kind == "link" or (kind == "assigned" and SCHEME.match(text, at)):
            for x in IN_LINK.finditer(text, at, end):
                lo, hi = x.span(x.lastgroup)
                known = KNOWN.fullmatch(text, lo, hi)
                # the name of the parameter alone: the host isn't about the value
                yield (known or x).lastgroup.rstrip("_"), lo, hi, re.split(r"[/?&@#;]", text[max(at, lo - 40) : lo])[-1], text[hi : min(end, hi + 40)]
                inside = True
        if not inside:
            yield kind, at, end, text[max(0, at - 40) : at], text[end : end + 40]


KINDS = ["private_key", "access_key", "prefixed", "assigned", "hex", "mixed", "address", "link"]
NAMING = frozenset("password passwd pwd secret token key apikey api_key access_key accesskey auth credential credentials bearer private login signing".split())
#: Words that name what looks like a key and is none.
PUBLIC = frozenset("sha sha1 sha256 sha512 md5 checksum digest commit revision etag hash hashes integrity fingerprint version build image icon uuid guid blob tree object author authors public type".split())
PLACEHOLDER = frozenset("example sample test dummy changeme placeholder xxxx your none null true false todo redacted insert replace foo bar".split())
#: Words of planted findings; the dictionary of a scan is learned from its documents (`frequent_words`).
WORDS = (
    "about account action admin agent amount answer archive article author backup basic batch block board branch browser buffer build button cache calendar camera change channel check city client cloud color command company config contact content "
    "country currency customer daily database debug default delivery design device directory document domain driver editor element email engine entry error event example export field filter folder format frame garden gateway general global graph group "
    "handler health history home image import index input invoice item journal kernel language layout letter level library list local machine manager market memory message method model module monitor network note number object offset option order output owner "
    "package page panel parent partner path pattern payment people plan player plugin policy position printer process product profile project public quality query queue random range record region release remote report request result review river role route "
    "sample schedule schema screen search section server service session shell signal source staging station status storage stream street style summary support system table target task team template thread ticket time title tool tracker transfer tree trigger "
    "union update upload user value vector vendor version video view visitor warning week widget window winter word worker world year yellow zebra zone"
).split()[::2]
#: Letter pairs that are frequent in words.
PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())
TRANSITIONS = [f"{a}{b}" for a in "dlus" for b in "dlus"]  # digit, lower, upper, sign
PLACES = ["before_1", "before_2", "before_3", "after_1"]
FEATURES = [
    *(f"is_{k}" for k in KINDS), *(f"from_{t}" for t in TRANSITIONS), "length", "log_length", "changes", "entropy", "distinct", "covered", "pairs", "is_path", "dots", "brackets", "placeholder", "quoted",
    *(f"naming_{p}" for p in PLACES), *(f"public_{p}" for p in PLACES),
]
SCHEMA = "doc_id bigint, row_hash bigint, start int, length int, kind string, value string, before string, after string, " + ", ".join(f"x_{f} double" for f in FEATURES)


def frequent_words(docs: DataFrame, most: int = 5000) -> frozenset[str]:
    """The dictionary of a corpus: of the words of 3 to 12 letters a-z (A-Z lowered) the `most` that occur in most documents, ties by the word.

    Counted over all whole texts; the driver gets `most` words. Null and empty texts have none.
    """
    words = F.array_distinct(F.filter(F.split(ascii_lower(F.col("text").cast("string")), r"[^a-z\x80-\x{10FFFF}]+"), lambda w: w.rlike(r"^[a-z]{3,12}$")))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect())


def covered(text: str, known: frozenset[str]) -> int:
    """Letters of a lower-case text that lie in words of the dictionary, taken from left to right, the longest first."""
    n = at = 0
    while at < len(text):
        k = next((k for k in range(12, 2, -1) if text[at : at + k] in known), 0) if text[at].isalpha() else 0
        n += k
        at += k or 1
    return n


STARTING = frozenset(WORDS) | NAMING


def class_of(c: str) -> str:
    return "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s"


def features(kind: str, value: str, before: str, after: str, known: frozenset[str] = STARTING) -> list[float]:
    n, k = len(value), "".join(map(class_of, value))
    steps = Counter(x + y for x, y in pairwise(k))
    counts = Counter(value).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    low = value.lower()
    letters = [x + y for x, y in pairwise(low) if x.isalpha() and y.isalpha()]
    words = [*re.findall(r"[a-z][a-z0-9_]*", before.lower())[:-4:-1], "", "", ""][:3] + [*re.findall(r"[a-z][a-z0-9_]*", after.lower())[:1], ""][:1]
    parts = [set(re.split(r"[_\d]+", w)) | {w} for w in words]
    naming = [bool(x & NAMING) or any(w.endswith(y) for y in ("token", "secret", "password", "passwd", "key")) for w, x in zip(words, parts, strict=True)]
    fake = any(w in PLACEHOLDER for w in re.findall(r"[a-z]+", " ".join([*before.split()[-1:], low]).lower())) or any(x in low for x in ("example", "changeme", "xxxx", "your")) or len(counts) <= 3
    path = value.count("/") >= 2 or bool(re.search(r"\.[a-z]{2,4}$", value)) or value.startswith(("/", "./", "http"))
    total = max(1, n - 1)
    return [
        *(float(kind == x) for x in KINDS), *(steps[t] / total for t in TRANSITIONS), float(n), math.log2(n), sum(v for t, v in steps.items() if t[0] != t[1]) / total, entropy, len(counts) / n,
        covered(low, known) / n, sum(x in PAIRS for x in letters) / max(1, len(letters)), float(path), value.count(".") / n, float(any(c in value for c in "(){}[]$<>%")), float(fake),
        float(before[-1:] in "\"'" and before != ""), *map(float, naming), *(float(bool(x & PUBLIC)) for x in parts),
    ]


def planted(n: int = 4000, seed: int = 7) -> Iterator[tuple[str, str, float]]:
    """Text, the finding in it, and whether it is a secret: n findings written down by kind of secret and of what is taken for one."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, a, b=None: "".join(rng.choices(letters, k=rng.randint(a, b or a)))
    hexa, every = (lambda a, b=None: some(digits + "abcdef", a, b)), (lambda a, b=None: some(lower + upper + digits, a, b))
    word = lambda: rng.choice(WORDS)
    name = lambda: rng.choice(["password", "db_password", "API_KEY", "api_key", "secret", "client_secret", "token", "auth_token", "ACCESS_TOKEN", "pwd", "passwd", "credential", "secretKey"])
    sign = lambda: rng.choice([" = ", "=", ": ", " => ", ":"])
    quote = lambda v: rng.choice(['"{}"', "'{}'", "{}"]).format(v)
    prose = lambda: " ".join(some(lower, 2, 9) if rng.random() < 0.5 else word() for _ in range(rng.randint(3, 9)))
    camel = lambda: "".join(word().title() for _ in range(rng.randint(4, 7))) + some(digits, 1, 2)
    strong = lambda: every(6, 24) + rng.choice("!#%*_-") + some(digits, 1, 3)
    true = [
        lambda: (name() + sign(), hexa(32, 64), True), lambda: (name() + sign(), every(16, 60), True), lambda: (name() + sign(), strong(), True),
        lambda: (name() + sign(), some(lower, 3, 6) + some(digits, 3, 6), True), lambda: ("", "AKIA" + some(upper + digits, 16), False), lambda: ("", "ghp_" + every(36), False),
        lambda: ("", "sk-" + every(40, 48), False), lambda: ("", "sk_live_" + every(24), False), lambda: ("", "xoxb-" + some(digits, 12) + "-" + every(24), False), lambda: ("", "AIza" + every(35), False),
        lambda: ("", "glpat-" + every(20), False), lambda: ("", f"eyJ{every(20, 40)}.{every(40, 90)}.{every(43)}", False), lambda: ("", f"-----BEGIN PRIVATE KEY-----\n{every(64)}\n{every(64)}\n-----END PRIVATE KEY-----", False),
        lambda: ("", every(32, 64), False), lambda: ("Authorization Bearer ", every(40, 64), False), lambda: ("key ", hexa(32, 64), False), lambda: (word() + " ", hexa(40, 64), False),
    ]
    false = [
        lambda: (name() + sign(), rng.choice(["changeme", "example", "your_password", "your-api-key-here", "password", "xxxxxxxxxxxx", "null", "None", "true", "false", "REDACTED", "placeholder", "test"]), True),
        lambda: (name() + sign(), rng.choice(["${%s}", "{{ %s }}", "os.environ[%s]", "getenv(%s)", "process.env.%s", "<%s>", "self.%s", "config.get(%s)"]) % word(), False), lambda: (name() + sign(), word(), True),
        lambda: ("author: ", word().title(), False), lambda: (rng.choice(["token_type", "auth_type", "password_field", "token_name"]) + sign(), word() + "_" + word(), True), lambda: (rng.choice(["commit ", "sha1 ", "md5: ", "checksum ", "etag: ", "sha256 = "]), hexa(32, 64), False),
        lambda: ("integrity sha512-", every(60, 86) + "==", False), lambda: ("", camel(), False), lambda: ("", "/".join([word() for _ in range(5)]) + "/V" + some(digits, 2), False), lambda: ("image ", "iVBORw0KGgo" + every(60, 300), False),
        lambda: ("", f"{word()}.{word()}@{word()}.com", False), lambda: ("", f"https://{word()}.com/{word()}/{word()}", False), lambda: ("", "AKIA" + some(upper, 9) + "EXAMPLE", False), lambda: ("", "sk-" + "x" * rng.randint(24, 40), False),
        lambda: ("version ", "V" + "-".join(some(digits, 2, 4) + word() for _ in range(4)), False), lambda: (name() + sign(), "/".join(["", word(), word(), word() + ".txt"]), True),
    ]
    for i in range(n):
        label = float(i % 2)
        context, value, quoted = rng.choice(true if label else false)()
        yield f"{prose()} {context}{quote(value) if quoted else value} {prose()}", value, label


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 7, known: frozenset[str] = STARTING) -> DataFrame:
    """The planted findings as rows of candidates() with their label."""
    rows = []
    for text, value, label in planted(n, seed):
        for kind, at, end, before, after in matches(text):
            if text[at:end].strip("\"'=") == value.strip("="):
                rows.append((None, None, at, end - at, kind, text[at:end], before, after, *features(kind, text[at:end], before, after, known), label))
    return spark.createDataFrame(rows, SCHEMA + ", label double")


def candidates(docs: DataFrame, known: frozenset[str] = STARTING) -> DataFrame:
    """A row per candidate of docs(doc_id, text): its place (code points), kind, value, neighbouring words and features; known: the dictionary.

    Null and empty texts hold none. row_hash tells texts of one id apart.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for doc_id, row_hash, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = t.as_py() or ""
                if not may_hold(text):
                    continue
                for kind, at, end, before, after in matches(text):
                    value = text[at:end]
                    rows.append((doc_id, row_hash, at, end - at, kind, value, before, after, *features(kind, value, before, after, known)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4, *[pa.float64()] * len(FEATURES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.where(text.isNotNull()).select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("h"), text).mapInArrow(found, SCHEMA)


def train(labelled: DataFrame, most_labelled: int = 20_000, trees: int = 30, depth: int = 8) -> RandomForestClassificationModel | None:
    """A forest on rows with the x_ columns and label; at most `most_labelled` rows, taken by hash. None unless both labels occur."""
    taken = labelled.orderBy(F.xxhash64("value", "before", "after")).limit(most_labelled)
    taken = VectorAssembler(inputCols=[f"x_{f}" for f in FEATURES], outputCol="x").transform(taken).select("x", "label").persist()
    try:
        if taken.select("label").distinct().count() < 2:
            return None
        return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(taken)
    finally:
        taken.unpersist()


def scored(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Candidates with their score, the forest's probability of a secret; 1 for known formats and 0 for others where there is no forest."""
    if model is None:
        return found.withColumn("score", F.col("kind").isin("private_key", "access_key", "prefixed").cast("double"))
    return model.transform(VectorAssembler(inputCols=[f"x_{f}" for f in FEATURES], outputCol="x").transform(found)).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings: doc_id, row_hash, start, length, kind, score of each candidate that the forest takes for a secret.

    The dictionary is that of the documents. labelled: rows of candidates() with a label (1 secret, 0 not), the planted ones if None;
    without both labels only keys of known formats are found. Null and empty texts hold nothing; rows of one id are told apart by row_hash, and repeated rows give their findings
    each; other columns are ignored; an empty table gives no rows.
    """
    known = frequent_words(docs) | STARTING
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession, known=known))
    return scored(candidates(docs, known), model).where(F.col("score") >= threshold).select("doc_id", "row_hash", "start", "length", "kind", "score")


def per_document(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, n_findings, findings (start, length, kind, score; by place), max_score of each row of docs; none: 0, empty, 0."""
    by = findings.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length", "kind", "score"))).alias("findings"))
    by = by.withColumnsRenamed({"doc_id": "d", "row_hash": "t"})
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("row_hash"))
    out = rows.join(by, rows["doc_id"].eqNullSafe(by["d"]) & (rows["row_hash"] == by["t"]), "left")
    none = F.array().cast("array<struct<start:int,length:int,kind:string,score:double>>")
    return out.select("doc_id", F.coalesce("findings", none).alias("findings")).select(
        "doc_id", F.size("findings").cast("bigint").alias("n_findings"), "findings", F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0)).alias("max_score")
    )


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each finding's characters replaced by `mark` and n_chars (if there) counted anew; other rows and columns as they were.

    Rows without findings, null and empty texts among them, stay as they are; repeated rows are changed alike; columns may have any names.
    """
    spans = findings.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    text = F.col("text").cast("string")
    # the row as one struct: its columns may have any names
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    joined = rows.join(spans, rows["own_id"].eqNullSafe(spans["doc_id"]) & (rows["own_hash"] == spans["row_hash"]), "left").select("row", "spans")
    text = F.col("row.text").cast("string")
    # pieces between the spans, each followed by the mark but the last; of spans that overlap each character counts once
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("gone"))

    def step(a, s):
        begin, end = F.greatest(a["at"], s["start"]), F.greatest(a["at"], s["start"] + s["length"])
        return F.when(end == a["at"], a).otherwise(
            F.struct(end.alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, begin - a["at"]), F.lit(mark)).alias("out"), (a["gone"] + end - begin - len(mark)).alias("gone"))
        )

    joined = joined.withColumn("new", F.aggregate("spans", zero, step))
    new = F.when(F.col("spans").isNull(), text).otherwise(F.concat("new.out", F.substring(text, F.col("new.at") + 1, F.length(text))))
    n_chars = F.length(text) - F.col("new.gone")
    field = lambda c: F.col("row").getField(c)
    columns = [new.alias(c) if c == "text" else F.when(F.col("spans").isNull(), field(c)).otherwise(n_chars.cast(t)).alias(c) if c == "n_chars" else field(c).alias(c) for c, t in docs.dtypes]
    return joined.select(*columns)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return per_document(docs, scan(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in the texts are replaced by [SECRET]; all documents stay, whatever their ids, repeats, nulls and further columns."""
    return redact(docs, scan(docs))
