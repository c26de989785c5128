"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of twelve or more key characters that holds a digit, or any run of six or more characters behind
a telling name and an assignment (``password = ...``), so letters alone are found there only. Its features are its length,
shares of character classes, character transitions, spread of characters, dictionary coverage, what the path says and
the words beside it, across an earlier candidate too. The forest is trained on labelled findings (a table of candidate,
context, path, label); with none given, on ``labelled_findings``, made here from a seed. Features, training and scoring are
DataFrame and MLlib operations.

Null and empty texts have no candidate. Rows are independent: repeated rows and ids are rows of their own. A null path says
nothing. A probability at the threshold is a secret. An empty table gives an empty result. Very long texts are searched whole; places
of candidates come from sums over blocks of them, so the time does not grow with their square. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textkernel import cut

_NAME = r"(?:passw(?:or)?d|pwd|secret|token|api.?key|access.?key|private.?key)"
_KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
_ASSIGNED = r"(?<=[:=\s\"'])(?=[^\s\"'<>]{6})(?<=" + _NAME + r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[^\s\"'<>]{6,64}"
CANDIDATE = f"{_KEY}|(?i:{_ASSIGNED})"
#: What a text with a candidate holds.
HINT = rf"[0-9]|(?i:{_NAME}[\"']?\s{{0,2}}[:=])"
#: Candidates whose lengths are summed at once.
RUN = 64
CONTEXT = 48
FINDINGS = 5000
THRESHOLD = 0.5
#: Bytes of rows with secrets (an id and the keys each) that are broadcast at most.
SMALL = 32 << 20
SECRET_WORDS = r"(token|secret|passw|passwd|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)"
NOISE_WORDS = r"(sha|md5|checksum|digest|hash|commit|uuid|guid|version|serial|isbn|doi|build|order|card|phone|call|id\b)"
PLACEHOLDER = r"(example|sample|dummy|changeme|placeholder|your|xxxx|test|fake|redacted|insert|1234567)"
TEST_PATH = r"(test|example|fixture|mock|doc|sample|readme)"
DICTIONARY = "(" + "|".join(sorted("about access account after again also application back been before build business call case change check class client code come config content count create data date default delete description detail different document element email error event example export false field file first format from function general good group handle have header high home host html http image import index info input insert install item just kernel know language last length level library line link list local login long mail main make many message method model module more most name network never node null number object option order other output over package page parameter part password path people place point print process product profile program project public query record release report request resource response result return root sample schema script search section select server service session should size some source start state status still string style system table target task test text than that them then there this time title token type under update upload user value version view want week well when which window with word work world write year your".split(), key=lambda w: (-len(w), w))) + ")"
FEATURES = ("length", "digits", "upper", "hexadecimal", "decimal", "spread", "transitions", "vowels", "repeats", "dictionary", "placeholder", "separators", "padded", "secret_word", "secret_near", "assigned", "quoted", "noise_word", "in_path", "test_path")


def features() -> dict[str, Column]:
    """Features of the columns candidate, before (text in front of it), path."""
    c, low = F.col("candidate"), F.lower("candidate")
    before = F.lower(F.col("before"))
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    edges = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hexadecimal": flag(c.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "decimal": flag(c.rlike(r"^[0-9-]+$")),
        "spread": F.size(F.array_distinct(F.split(low, ""))) / n,
        "transitions": F.regexp_count(c, F.lit(edges)) / n,
        "vowels": F.regexp_count(low, F.lit("[aeiou]")) / n,
        "repeats": flag(low.rlike(r"(.)\1{3,}")),
        "dictionary": (n - F.length(F.regexp_replace(low, DICTIONARY, ""))) / n,
        "placeholder": flag(low.rlike(PLACEHOLDER)),
        "separators": share("[_/-]"),
        "padded": flag(c.endswith("=")),
        "secret_word": flag(before.rlike(SECRET_WORDS)),
        "secret_near": flag(before.rlike(SECRET_WORDS + r"\w{0,8}\W{0,14}$")),
        "assigned": flag(before.rlike(r"[:=]\W{0,8}$")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "noise_word": flag(before.rlike(NOISE_WORDS + r"\W{0,14}$")),
        "in_path": flag(before.rlike(r"(://|/)\S*$")),
        "test_path": flag(F.lower("path").rlike(TEST_PATH)),
    }


def _vectors(rows: DataFrame) -> DataFrame:
    made = rows.select("*", *[F.coalesce(v, F.lit(0.0)).cast("double").alias(f"f_{k}") for k, v in features().items()])
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(made).drop(*[f"f_{k}" for k in FEATURES])


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 11) -> DataFrame:
    """candidate, before, path, label: made findings, a row for each number below n.

    Secrets are random keys behind an assignment to a telling name, now and then under noise or in capitals.
    The rest are checksums, ids, versions, numbers, paths, names and placeholders."""
    d = lambda salt: F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("id")))
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.conv(F.substring(d(salt), 1, 6), 16, 10).cast("int") % len(of) + 1).cast("int"))
    long = F.concat(d("a"), d("b"))
    base64 = F.translate(F.base64(F.unhex(F.concat(d("c"), d("d")))), "\r\n", "")
    name = pick("name", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "bearer", "passwd")
    mark = pick("mark", " = \"", "=", ": \"", ": ", " = '", "=\"", " =!! \"", "!! =!! \"", " | = | \"", "$$$ = \"", " => \"", " = ")
    lead = pick("lead", "the value of ", "config ", "and then, ", "export ", "", "word of ", "In ", "| ")
    key = F.concat(lead, name, mark)
    plain = F.concat(lead, pick("noun", "commit ", "sha256:", "md5 ", "checksum = ", "uuid: ", "build ", "version = \"", "digest: \"", "id = ", "order ", "serial: "))
    prose = F.concat(lead, pick("prose", "see ", "of the ", "on ", "", "with ", "called ", "card ", "number ", "at "))
    words = F.concat_ws("_", pick("w1", "user", "report", "event", "page", "model", "server"), pick("w2", "profile", "status", "index", "table", "update", "result"), F.substring(d("w3"), 1, 2), F.lit("1"))
    number = F.translate(F.substring(long, 1, 16), "abcdef", "123456")
    path = F.concat_ws("/", pick("p1", "src", "usr", "var", "home"), pick("p2", "lib", "data", "image", "module"), pick("p3", "file2", "page10", "index3", "v2"))
    holder = pick("h", "your_token_here1", "xxxxxxxxxxxx1234", "example_key_12345", "changeme12345678", "dummy-secret-001", "test_token_123456", "placeholder_0001", "1234567890123456")
    letters = F.translate(F.substring(base64, 1, 20), "0123456789+/=", "gHjKmNpQrSxYz")
    phrase = F.concat(pick("s1", "Tr0ub4dor", "P@ssw0rd", "hunter", "S3cure", "qwErty", "let.me.in"), pick("s2", "!", "#", "$", "@", "_"), F.substring(d("s3"), 1, 5), pick("s4", "!", "?", "%", "&", "X"))
    spoken = F.concat(pick("v1", "required", "changed", "something", "expired", "between", "unknown", "whatever", "encrypted", "disabled"), pick("v2", "", ".", ",", "er", "ly", "ing"))
    k = F.col("id") % 20
    cases = [
        (0, F.substring(long, 1, 40), key, 1), (1, F.substring(long, 1, 32), key, 1), (2, F.substring(base64, 1, 40), key, 1),
        (3, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(long, 1, 16), "01", "QZ"))), F.concat(lead, pick("aws", "aws ", "key ", "id = \"", "")), 1),
        (4, F.concat(F.lit("ghp_"), F.translate(F.substring(base64, 1, 36), "+/=", "xYz")), F.concat(lead, mark), 1), (5, long, key, 1),
        (6, F.upper(F.substring(long, 1, 40)), F.upper(key), 1), (7, F.substring(base64, 1, 24), key, 1),
        (8, F.substring(long, 1, 40), plain, 0), (9, F.regexp_replace(F.substring(long, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), plain, 0),
        (10, words, F.concat(lead, pick("any", "name = ", "", "table ", "key: ", "token = ")), 0), (11, number, prose, 0), (12, path, F.concat(lead, F.lit("https://host.example/")), 0),
        (13, holder, key, 0), (14, F.concat(F.lit("20"), F.translate(F.substring(d("t"), 1, 2), "abcdef", "012345"), F.lit("-01-12T10")), prose, 0), (15, long, plain, 0),
        (16, letters, key, 1), (17, phrase, key, 1), (18, spoken, F.concat(lead, name, pick("colon", ": ", " = ", "=", ": ")), 0), (19, spoken, F.concat(lead, pick("ask", "the password: ", "your token: ", "a secret: ", "Secret: ")), 0),
    ]
    choose = lambda at: F.coalesce(*[F.when(k == i, F.lit(c[at]) if at == 3 else c[at]) for i, *c in [(x[0], None, *x[1:]) for x in cases]])
    return spark.range(0, n, 1, 1).select(choose(1).alias("candidate"), choose(2).alias("before"), pick("path", "src/main", "config/app", "src0", "src7", "tests/unit", "docs/readme").alias("path"), choose(3).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """The forest, from a bounded table of labelled findings."""
    rows = _vectors(findings).select("features", "label").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(rows)


def _let(value: Column, of) -> Column:
    """of(value), where the value is made once though it is used in a lambda."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _starts(hits: Column, gaps: Column) -> Column:
    """Where each hit starts: after i + 1 gaps and i hits. Sums of runs of hits first, then within runs."""
    n = F.size(hits)
    step = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(gaps, i))).cast("bigint"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    runs = lambda s: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda r: total(F.slice(s, r * RUN + 1, F.lit(RUN))))
    before = lambda t: F.aggregate(t, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    at = lambda s, b: F.transform(hits, lambda _, i: F.get(b, F.floor(i / RUN).cast("int")) + total(F.slice(s, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + F.length(F.get(gaps, i)))
    return _let(step, lambda s: _let(runs(s), lambda t: _let(before(t), lambda b: at(s, b))))


#: The forest of the findings made here, by application: they are the same each time.
_OWN: dict[str, RandomForestClassificationModel] = {}


def forest(spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    """Trained on the findings given, or on those made here, once in an application."""
    if findings is not None:
        return train(findings)
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = train(labelled_findings(spark))
    return _OWN[key]


def candidates(docs: DataFrame, keep: list[str], path: str = "source") -> DataFrame:
    """A row per candidate: ``keep``, number, start (code points), candidate, before, path."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, F.col(path).cast("string").alias("path"), text.alias("_text")).filter(F.col("_text").rlike(HINT))
    rows = rows.select(*keep, "path", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_hits"), F.split("_text", CANDIDATE, -1).alias("_gaps")).filter(F.size("_hits") > 0)
    last = lambda c: F.substring(c, -CONTEXT, CONTEXT)
    none = F.lit("")
    before = lambda h, g: F.transform(h, lambda _, i: last(F.concat(F.when(i > 0, F.concat(last(F.get(g, i - 1)), F.get(h, i - 1))).otherwise(none), F.get(g, i))))
    made = _let(F.col("_hits"), lambda h: _let(F.col("_gaps"), lambda g: F.arrays_zip(h.alias("hit"), _starts(h, g).alias("at"), before(h, g).alias("before"))))
    out = rows.select(*keep, "path", F.posexplode(made).alias("number", "_x"))
    return out.select(*keep, "number", F.col("_x.at").alias("start"), F.col("_x.hit").alias("candidate"), F.col("_x.before").alias("before"), "path")


def judge(found: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds probability and is_secret."""
    scored = model.setFeaturesCol("features").transform(_vectors(found)).withColumn("probability", F.round(vector_to_array("probability")[1], 9))
    return scored.select(*found.columns, "probability", (F.col("probability") >= threshold).alias("is_secret"))


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """doc_id, number, start, length (code points), candidate, probability, is_secret: a row per candidate."""
    model = forest(docs.sparkSession, findings)
    found = judge(candidates(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], path), model)
    return found.select("doc_id", "number", "start", F.length("candidate").cast("long").alias("length"), "candidate", "probability", "is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", by: str = "<secret>") -> DataFrame:
    """docs with each confirmed secret in ``text`` replaced; ``n_chars``, if there, follows. Same columns.

    Rows are matched by id and text hash. The texts are not shuffled while what was found takes ``SMALL`` bytes or fewer."""
    model = forest(docs.sparkSession, findings)
    key = F.xxhash64(F.col("doc_id").cast("string"), "text", path)
    found = judge(candidates(docs.select(key.alias("__id"), "text", path), ["__id"], path), model).filter("is_secret")
    by_row = cut(found.groupBy("__id").agg(F.collect_set("candidate").alias("__secrets")))
    held = by_row.agg(F.sum(F.expr("48 + aggregate(__secrets, 0L, (n, s) -> n + octet_length(s) + 24)")).alias("b")).first()["b"] or 0
    if held <= SMALL:
        by_row = F.broadcast(by_row)
    out = docs.withColumn("__id", key).join(by_row, "__id", "left")
    clean = F.aggregate(F.array_sort("__secrets", lambda a, b: F.length(b) - F.length(a)), F.col("text"), lambda t, s: F.replace(t, s, F.lit(by)))
    text = F.when(F.col("__secrets").isNull(), F.col("text")).otherwise(clean)
    made = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])
