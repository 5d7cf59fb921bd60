"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates and features are built-in string functions, the forest is Spark ML's, so nothing
leaves the JVM.  Features are the candidate's length, its character transitions, the share
of it that dictionary words cover, its path, and the words beside it.  The forest is trained
from labelled findings; ``labelled_findings`` makes a documented set where none is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.llm.common import table
from skiff.session import materialize

#: Words that name a credential, and words that name another kind of long string.
KEY_WORDS = r"tokens?|secrets?|passw(?:or)?d|passwd|pwd|api[_ -]?keys?|access[_ -]?keys?|auth\w*|private[_ -]?keys?|client[_ -]?secret|credentials?|bearer|signing[_ -]?key"
OTHER_WORDS = r"sha\d*|md5|checksums?|commits?|digest|hash(?:es)?|etag|uuid|guid|revision|integrity|build|version|file|image|session|order|invoice|isbn|doi|page|ref"
#: What stands for a credential without being one.
PLACEHOLDERS = (
    r"example|sample|placeholder|change[_-]?me|your|dummy|fake|test|todo|insert|replace|here|xxx+|0000+|1234\d*|abcd?e?f?|password|secret|token|"
    r"api|key|name|value|none|null|default|string|user|admin|my|the|and|for|with|from|this|that|demo|foo|bar|file|report|final|image|version|item|data|number|is|a"
)
TEST_PATHS = r"(?i)(?:^|[/._-])(?:tests?|specs?|examples?|samples?|fixtures?|mocks?|docs?)(?:[/._-]|$)"

_RUN = r"[A-Za-z0-9+/_=~-]"
#: Names whose value is a candidate whatever its length and characters.
_NAMED = r"(?i:tokens?|secrets?|passw(?:or)?d|passwd|pwd|passphrase|(?:api|access|private|signing|secret|auth)[_ -]?key|credentials?)"
_PEM_BREAK = r"(?:\s|\\[nr]|[\"'+,|>#*])*+"
_PEM_KIND = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A private key from its first line to its last, or, without that, over the lines of its body.
_PEM = (
    rf"-----BEGIN {_PEM_KIND}(?:{_PEM_BREAK}(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n\\]*+)*+(?:{_PEM_BREAK}[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"(?:(?:{_PEM_BREAK}[A-Za-z0-9+/=]++){{0,2}}+{_PEM_BREAK}-----END {_PEM_KIND})?"
)
_VALUE_AHEAD = rf"(?<={_RUN}[:=]|[:=] |[:=][\"']|[:=] [\"'])"
#: A private key; the value behind a credential's name, quoted or bare; a signed token of dotted
#: parts; any value of eight or more characters behind a sign; any run of sixteen or more
#: characters, one of them a digit.
CANDIDATE = (
    rf"{_PEM}"
    rf"|(?<=[:=]|[:=][ \"']|[:=] [\"'])(?<={_NAMED}[\"']?[ ]?[:=]{{1,2}}[ ]?[\"'])[^\s\"']++(?=[\"'])"
    rf"|(?<=[:=]|[:=] )(?<={_NAMED}[\"']?[ ]?[:=]{{1,2}}[ ]?)[^\s\"'<>,;:=]++"
    rf"|(?<!{_RUN})eyJ[A-Za-z0-9_=-]{{8,}}+\.[A-Za-z0-9_=-]{{8,}}+(?:\.[A-Za-z0-9_=-]*+)?"
    rf"|{_VALUE_AHEAD}{_RUN}[A-Za-z0-9+/_=~.!@#%^&*-]{{7,}}"
    rf"|(?<!{_RUN})(?=[A-Za-z+/_=~-]*+[0-9]){_RUN}{{16,}}"
)
BESIDE = 48
TREES, DEPTH, SEED = 40, 7, 11
#: Labelled findings of the set made here, by each of its kinds.
PER_KIND = 200

FEATURES = (
    "length digits uppers lowers marks distinct turns sounds longest_letters hex_only covered keyed_before assigned quoted other_before keyed_near test_path pem hash_lead".split()
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, text_key (a hash of the text), path, start (characters from 0), value, before, after.

    Null texts have none; texts without a digit, colon or equals sign are not searched.
    """
    path = F.col(f"`{path_col}`") if path_col in docs.columns else F.lit(None)
    t = docs.select(F.col(f"`{id_col}`").alias("id"), path.cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    t = t.where(F.col("text").rlike("[0-9:=]|-----BEGIN ")).select("id", "path", F.xxhash64("text").alias("text_key"), "text")
    found = t.select("id", "path", "text_key", "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values")).where(F.size("values") > 0)
    pieces = found.select("id", "path", "text_key", "values", F.split("text", CANDIDATE, -1).alias("pieces"))
    # a match begins where the pieces and matches before it end
    steps = F.transform(F.arrays_zip(F.slice("pieces", 1, F.size("values")).alias("p"), F.col("values").alias("v")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["v"]).alias("v")))
    placed = pieces.select("id", "path", "text_key", "values", "pieces", steps.alias("steps"))
    ends = F.aggregate(
        "steps",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x["p"] + x["v"]).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x["p"])).alias("all")),
        lambda acc: acc["all"],
    )
    rows = placed.select("id", "path", "text_key", "values", "pieces", ends.alias("starts"))
    one = F.transform(
        "values",
        lambda v, i: F.struct(
            F.get("starts", i).alias("start"), v.alias("value"), F.right(F.get("pieces", i), F.lit(BESIDE)).alias("before"), F.left(F.get("pieces", i + 1), F.lit(BESIDE)).alias("after")
        ),
    )
    return rows.select("id", "path", "text_key", F.explode(one).alias("c")).select("id", "path", "text_key", "c.*")


def _share(value: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(value, kind, "")).cast("double") / F.greatest(F.length(value), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """``found`` (value, before, after, path) plus the columns of ``FEATURES`` as doubles."""
    v, before, after = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    low = F.lower(v)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    letters = F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))
    made = {
        "length": F.length(v).cast("double"),
        "digits": _share(v, "[^0-9]"),
        "uppers": _share(v, "[^A-Z]"),
        "lowers": _share(v, "[^a-z]"),
        "marks": _share(v, "[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(40.0)),
        # changes between lower case, upper case and digits
        "turns": F.regexp_count(v, F.lit("(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[a-z])")) / size,
        # changes between vowels and consonants, as in words
        "sounds": F.regexp_count(low, F.lit("(?<=[aeiouy])(?=[bcdfghj-np-tv-xz])|(?<=[bcdfghj-np-tv-xz])(?=[aeiouy])")) / size,
        "longest_letters": F.coalesce(F.array_max(letters), F.lit(0)) / size,
        "hex_only": flag(low.rlike("^[0-9a-f]+$")),
        "covered": 1.0 - F.length(F.regexp_replace(low, PLACEHOLDERS, "")) / size,
        "keyed_before": flag(before.rlike(rf"(?i)(?:{KEY_WORDS})[\"']?\s*(?:[:=]+\s*|\s)[\"']?$")),
        "assigned": flag(before.rlike(r"[:=]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "other_before": flag(before.rlike(rf"(?i)(?:^|\W)(?:{OTHER_WORDS})\W{{0,4}}$")),
        "keyed_near": flag(before.rlike(rf"(?i)(?:{KEY_WORDS})")),
        "test_path": flag(F.col("path").rlike(TEST_PATHS)),
        "pem": flag(v.startswith("-----BEGIN ")),
        "hash_lead": flag(low.rlike("^(?:sha[0-9]+|md5)[-:]")),
    }
    return found.select("*", *[made[n].cast("double").alias(n) for n in FEATURES])


def labelled_findings(spark: SparkSession, per_kind: int = PER_KIND) -> DataFrame:
    """value, before, after, path, label (1: a secret): ``per_kind`` findings of each of 32
    kinds, whose random parts are hashes of their number."""
    n = spark.range(0, per_kind, 1, 2)
    sha1, md5, sha2 = (f"{f}(concat(id, salt{a}))" for f, a in (("sha1", ""), ("md5", ""), ("sha2", "")))
    sha2 = "sha2(concat(id, salt), 256)"
    b64 = "translate(base64(unhex(sha2(concat(id, salt), 256))), '+/=', 'Zq7')"
    upper = "upper(substring(md5(concat(id, salt)), 1, 16))"
    uuid = "regexp_replace(md5(concat(id, salt)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '$1-$2-$3-$4-$5')"
    some = "element_at(array('alpha','river','north','green','water','signal','delta','forest'), cast(1 + id % 8 as int))"
    key = "element_at(array('token','secret','api_key','password','access_key','auth_token','TOKEN','client_secret'), cast(1 + id % 8 as int))"
    login = "element_at(array('password','passwd','pwd','passphrase'), cast(1 + id % 4 as int))"
    mark = "element_at(array('!','#','&','%','@','*'), cast(1 + id % 6 as int))"
    lead = "element_at(array('the ','and so ','of the line. ','','const ','export ','de la ','und der '), cast(1 + (id div 8) % 8 as int))"
    path = "element_at(array('src0','src7','app/main.py','web','config/prod.env'), cast(1 + id % 5 as int))"
    quoted, bare, colon = f"concat({lead}, {key}, ' = \"')", f"concat({lead}, {key}, '=')", f"concat({lead}, '\"', {key}, '\": \"')"
    kinds = [
        # secrets
        (sha1, quoted, "'\" '", path, 1),
        (sha1, colon, "'\",'", path, 1),
        (f"upper({sha1})", quoted, "'\"!! '", path, 1),
        (md5, bare, "' '", path, 1),
        (b64, quoted, "'\"\n'", path, 1),
        (f"substring({b64}, 1, 20)", colon, "'\"'", path, 1),
        (f"concat('AKIA', {upper})", f"concat({lead}, 'key ')", "' '", path, 1),
        (f"concat('ghp_', substring({b64}, 1, 36))", lead, "' '", path, 1),
        (f"concat('sk-', {b64})", quoted, "'\"'", path, 1),
        (f"concat('eyJ', {b64}, 'eyJ', {b64})", f"concat({lead}, 'Bearer ')", "' '", path, 1),
        ("concat('-----BEGIN ', element_at(array('RSA ', 'EC ', ''), cast(1 + id % 3 as int)), 'PRIVATE KEY-----')", lead, "'\n'", path, 1),
        (f"substring({b64}, 1, 14)", f"concat({lead}, 'password: ')", "' '", path, 1),
        (f"concat({some}, 1 + id % 97)", f"concat({lead}, {login}, ' = \"')", "'\" '", path, 1),
        (f"concat({mark}, substring({b64}, 1, cast(5 + id % 6 as int)), {mark}, id % 10)", f"concat({lead}, {login}, ': \"')", "'\" '", path, 1),
        (f"concat(substring({b64}, 1, 4), {mark}, substring({b64}, 9, 3))", f"concat({lead}, {login}, '=')", "' '", path, 1),
        (
            f"concat('-----BEGIN RSA PRIVATE KEY-----\n', {b64}, {b64}, '\n', substring({b64}, 1, 20), '\n-----END RSA PRIVATE KEY-----')",
            lead, "'\n'", path, 1,
        ),
        (f"concat('eyJ', substring({b64}, 1, 20), '.eyJ', {b64}, '.', {b64})", quoted, "'\"'", path, 1),
        # others
        (sha1, f"concat({lead}, 'commit ')", "' '", path, 0),
        (sha2, f"concat({lead}, 'sha256: ')", "' '", path, 0),
        (md5, f"concat({lead}, 'checksum ')", "'.'", path, 0),
        (uuid, f"concat({lead}, 'id: ')", "' '", path, 0),
        (f"concat('your_', {some}, '_token_here_', id)", quoted, "'\"'", path, 0),
        (f"concat('EXAMPLE', upper({some}), 'KEY1234567')", quoted, "'\"'", path, 0),
        ("concat('xxxxxxxxxxxxxxxx', id)", bare, "' '", path, 0),
        (f"concat({some}, '-report-2016-', 10 + id % 3, '-', 10 + id % 18, '-final')", lead, "' '", path, 0),
        (f"concat({some}, {some}, 'ing', {some}, id)", f"concat({lead}, 'x = ')", "' '", path, 0),
        (f"concat({some}, '_', {some}, '_number_', id, '_', {some})", lead, "' '", path, 0),
        (f"concat('/', {some}, '/', {some}, '/page', id, '/', {some})", f"concat({lead}, 'see ')", "' '", path, 0),
        (some, f"concat({lead}, {key}, ': ')", "' is here'", path, 0),
        ("element_at(array('string','null','true','none','required','${TOKEN}','optional','number'), cast(1 + id % 8 as int))", colon, "'\",'", path, 0),
        (f"concat('sha', element_at(array('256','384','512'), cast(1 + id % 3 as int)), '-', {b64}, substring({b64}, 1, 20))", f"concat({lead}, 'integrity=\"')", "'\" '", path, 0),
        (sha1, quoted, "'\"'", "element_at(array('tests/unit.py','docs/example.md','spec/fixtures/a'), cast(1 + id % 3 as int))", 0),
    ]
    parts = [
        n.selectExpr("id", f"'k{k}' as salt").selectExpr(f"{v} as value", f"{b} as before", f"{a} as after", f"{p} as path", f"cast({y} as double) as label")
        for k, (v, b, a, p, y) in enumerate(kinds)
    ]
    return reduce(DataFrame.union, parts)


def fit_forest(labelled: DataFrame):
    """A random forest on the features of labelled findings (value, before, after, path, label)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = materialize(with_features(labelled).select(*FEATURES, "label").coalesce(2), "labelled")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def find_secrets(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: the id, text_key, start, length, value, score, is_secret.

    Repeated rows repeat their candidates; a text without any, or null, has no row.
    """
    from pyspark.ml.functions import vector_to_array

    model = model or fit_forest(labelled_findings(docs.sparkSession))
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    score = vector_to_array("probability")[1]
    return scored.select(
        F.col("id").alias(id_col), "text_key", F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("length"), "value", score.alias("score")
    ).withColumn("is_secret", F.col("score") >= threshold)


def redact_secrets(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; all rows and columns stay."""
    secrets = find_secrets(docs, model, id_col, text_col, path_col).where("is_secret")
    spans = secrets.groupBy(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("_spans"))
    spans = materialize(spans, "secrets")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.col("_doc")[text_col]
    left = left.withColumn("_text_key", F.xxhash64(text))
    both = left.join(spans, (F.col("_text_key") == F.col("_key")) & F.col("_doc")[id_col].eqNullSafe(F.col("_id")), "left")
    # what stands before each secret, then what stands behind the last
    built = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            (s["start"] + s["length"]).alias("at"),
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    new = F.when(F.col("_spans").isNull(), text).otherwise(built)
    return both.select(*[new.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])


def op5_secret_scan(spark, sf_dir):
    """Query: every candidate of every document with its verdict."""
    return find_secrets(table(spark, sf_dir, "documents"))
