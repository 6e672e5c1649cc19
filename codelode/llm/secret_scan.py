"""Secret scans: patterns find candidates, a random forest removes the false positives. DataFrame functions only.

The forest is trained from labelled findings on the candidate's length, its
character transitions (changes of class, and the share of letter pairs that are common in
prose), how much of it dictionary words cover, what its path looks like and the
words on both sides. The trained trees become nested CASE expressions, so scoring
runs inside the scan of the texts, without a shuffle. Every place of a candidate is
scored with its own neighbours. Findings are labelled by a seeded generator of key
formats (positives) and of the look-alikes that scanners report (negatives), in
contexts and paths that lean to one label; a table of real labelled findings can be
given instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that mark an assignment of a credential, and the shapes of well-known keys.
KEY_NAMES = "password|passwd|pwd|passphrase|secret|token|api_key|api-key|apikey|access_key|access-key|auth_key|private_key|credential"
SHAPES = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?|"
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|"
    r"\bgh[pousr]_[0-9A-Za-z]{36,}|"
    r"\bxox[abprs]-[0-9A-Za-z-]{10,}|"
    r"\bsk[-_](?:live|test|proj)?[-_]?[0-9A-Za-z]{20,}|"
    r"\bAIza[0-9A-Za-z_-]{35}|"
    r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
)
# Words whose presence in a candidate speaks for a name, a placeholder or prose.
DICTIONARY = (
    "password|passwd|secret|token|example|sample|dummy|changeme|change|placeholder|default|test|your|here|insert|none|null|true|false|"
    "key|value|name|user|admin|login|config|version|license|public|general|http|https|www|com|org|net|html|mail|the|and|for|with|this|that|"
    "from|have|will|file|path|data|code|index|page|image|content|article|function|return|class|import|string|number|object|array|list|"
    "server|client|request|response|message|error|debug|release|build|branch|commit|xxxx|0000|1234|abcd"
)
# Letter pairs that are frequent in European prose.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|ri|ro|ic|ne|ea|ra|ce|ch|ei|ie|la|el|qu|ai|un"
# Words of a text that shows how to write a key rather than a key.
SHOWN = "example|sample|placeholder|replace|dummy|fake|e\\.g\\.|format|looks like|checksum|commit|sha|hash|digest|uuid|revision|build|version"
#: Assigned values, key shapes, and long runs that mix letters and digits. Group 1 is the whole candidate.
PATTERN = (
    rf"((?i:(?<![A-Za-z0-9])(?:{KEY_NAMES})[\"']?\s?[:=]\s?[\"']?[^\s\"']{{4,}})|{SHAPES}|"
    r"(?<![0-9A-Za-z_/+=.@-])(?=[A-Za-z_/+=-]*[0-9])(?=[0-9_/+=-]*[A-Za-z])[0-9A-Za-z_/+=-]{20,})"
)
NAME = rf"(?i)^(?:{KEY_NAMES})[\"']?\s?[:=]\s?[\"']?"
#: Characters on either side of a candidate that count as its neighbours.
NEAR = 48

FEATURES = ["length", "transitions", "pairs", "digits", "uppers", "distinct", "words", "repeats", "assigned", "shaped", "hex", "named", "shown", "path"]


def features(found: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """Numeric features of one finding, in the order of FEATURES."""
    value = F.regexp_replace(found, NAME, "")
    size = F.greatest(F.length(value), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / size

    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("double"), F.lit(0.0))

    return [
        F.length(value).cast("double"),
        # places where a letter meets a digit or lower case meets upper case
        F.regexp_count(value, F.lit(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")) / size,
        F.regexp_count(value, F.lit(f"(?i)(?={PAIRS})")) / size,
        share("[0-9]"),
        share("[A-Z]"),
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.least(size, F.lit(64.0)),
        share(f"(?i)(?:{DICTIONARY})"),
        share(r"(.)\1+"),
        flag(found.rlike(NAME)),
        flag(value.rlike(f"^(?:{SHAPES})")),
        flag(value.rlike("^[0-9a-f-]+$")),
        flag(F.lower(before).rlike(rf"\b(?:{KEY_NAMES}|key|bearer|authorization|login)\b")),
        flag(F.lower(F.concat_ws(" ", before, after)).rlike(rf"\b(?:{SHOWN})")),
        flag(F.lower(path).rlike(r"test|example|sample|fixture|docs?/|readme|mock")),
    ]


# Words of prose that make up passwords and harmless values alike; few of them are in DICTIONARY.
PROSE = (
    "river|castle|summer|orange|window|planet|silver|dragon|monkey|garden|winter|coffee|hunter|bridge|flower|forest|mountain|yellow|purple|rocket|"
    "kitchen|library|morning|evening|teacher|station|journey|picture|battery|correct|horse|staple|letter|market|people|street|animal|doctor|farmer|island"
)


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 7) -> DataFrame:
    """(found, before, after, path, label): ``n`` generated findings, half of them secrets.

    Secrets lean to neighbours that name a credential and to ordinary paths, the others to
    neighbours that show a format and to paths of tests and documents, neither always.
    """

    def roll(salt: int, sides: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(sides)).cast("int")

    def text(salt: int, alphabet: str, length: int) -> Column:
        # letters of the alphabet picked by digests of the row number
        pick = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64("id", i, F.lit(salt), F.lit(seed)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), pick), "")

    def one_of(salt: int, *options: str | Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in options]), roll(salt, len(options)) + 1)

    def word(salt: int) -> Column:
        return one_of(salt, *PROSE.split("|"))

    upper, lower, digit, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    mixed = lower + lower.upper() + digit
    key = F.concat(one_of(99, *KEY_NAMES.split("|")), one_of(98, "=", ': "', ' = "', " = ", ": "))
    real = [
        F.concat(F.lit("AKIA"), text(1, upper, 16)),
        F.concat(key, text(2, hexa, 18)),
        F.concat(key, text(3, hexa, 40)),
        F.concat(key, text(4, mixed + "!$%&#", 14)),
        F.concat(F.lit("ghp_"), text(5, mixed, 36)),
        F.concat(F.lit("eyJ"), text(6, mixed, 20), F.lit("."), text(7, mixed, 40), F.lit("."), text(8, mixed, 43)),
        text(9, mixed, 40),
        F.concat(F.lit("sk_live_"), text(10, mixed, 24)),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), text(12, mixed + "+/", 200), F.lit("\n-----END RSA PRIVATE KEY-----")),
        F.concat(key, text(11, mixed, 24)),
        F.concat(key, word(13), text(14, digit, 1), one_of(70, word(15), "secret", word(71), "admin", "login")),
        F.concat(key, F.initcap(word(16)), text(17, digit, 4), one_of(18, "!", "#", "$", "")),
        text(19, mixed, 28),
    ]
    false = [
        F.concat(key, F.lit("<"), word(21), F.lit("-"), word(40), F.lit(">")),
        F.concat(key, word(22)),
        F.concat(key, F.lit("${"), F.upper(word(23)), F.lit("}")),
        F.concat(text(24, hexa, 8), F.lit("-"), text(25, hexa, 4), F.lit("-"), text(26, hexa, 4), F.lit("-"), text(27, hexa, 12)),
        F.concat(word(28), F.lit("_"), word(29), F.lit("_"), word(30), F.lit("_"), text(31, digit, 3)),
        F.concat(key, one_of(32, "changeme", "placeholder", "your-key-here", "none", "null", "required", "string")),
        F.concat(word(33), F.lit("/"), word(34), F.lit("/"), word(35), F.lit("/"), text(36, digit, 4)),
        F.concat(key, F.repeat(one_of(37, "x", "*", "0", "."), 16)),
        F.concat(key, word(38), F.lit("."), word(39), F.lit("()")),
        F.concat(word(41), F.lit("-"), word(42), F.lit("-"), word(43), F.lit("-"), text(44, digit, 2)),
        text(45, hexa, 40),
        F.concat(F.lit("a1"), F.repeat(one_of(46, "=-", "-", "_", "="), 20)),
        F.concat(key, one_of(52, "changeme", "example", "test", "password", "sample", "dummy"), text(53, digit, 1), one_of(54, "", "23", "234")),
        F.concat(F.initcap(word(47)), F.initcap(word(48)), F.initcap(word(49)), F.initcap(word(50)), text(51, digit, 1)),
    ]
    label = F.col("id") % 2 == 1
    naming = one_of(60, "use the api key ", "Authorization: Bearer ", "login with token ", "my password is ")
    showing = one_of(61, "for example ", "see commit ", "the checksum is ", "replace the sample ", "a dummy value like ")
    neutral = one_of(62, "and with the ", "then ", "it was in ", "", "there is ")
    mark = roll(63, 20)
    rows = spark.range(n).select(
        F.when(label, one_of(64, *real)).otherwise(one_of(65, *false)).alias("found"),
        F.when(mark < F.when(label, 9).otherwise(4), naming).when(mark >= F.when(label, 19).otherwise(13), showing).otherwise(neutral).alias("before"),
        one_of(66, " and more", "", " in it.", " for now", " today").alias("after"),
        F.when(roll(67, 20) < F.when(label, 2).otherwise(9), one_of(68, "tests/fixture", "docs/readme", "examples/first")).otherwise(one_of(69, "src/app", "forum", "web", "chat")).alias("path"),
        label.cast("double").alias("label"),
    )
    return rows


def train_forest(findings: DataFrame, trees: int = 15, depth: int = 7, seed: int = 11) -> list[dict]:
    """Fit a random forest to labelled findings (found, before, after, path, label); each tree as nested dicts."""
    rows = findings.select(*[c.alias(n) for n, c in zip(FEATURES, features(*map(F.col, ("found", "before", "after", "path"))), strict=True)], "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows.coalesce(1))

    def tree(node) -> dict:
        if node.getClass().getSimpleName().startswith("Leaf"):
            stats = list(node.impurityStats().stats())
            return {"p": stats[1] / sum(stats)}
        split = node.split()
        return {"f": split.featureIndex(), "at": split.threshold(), "le": tree(node.leftChild()), "gt": tree(node.rightChild())}

    return [tree(t.rootNode()) for t in model._java_obj.trees()]


def forest_score(forest: list[dict], values: list[Column]) -> Column:
    """The mean of the trees' leaf shares as one expression."""

    def of(node: dict) -> Column:
        if "p" in node:
            return F.lit(float(node["p"]))
        return F.when(values[node["f"]] <= float(node["at"]), of(node["le"])).otherwise(of(node["gt"]))

    return reduce(lambda a, b: a + b, [of(t) for t in forest]) / len(forest)


_forests: dict[tuple, list[dict]] = {}


def default_forest(spark: SparkSession) -> list[dict]:
    """The forest of the generated findings; trained once per driver, as it doesn't depend on the data scanned."""
    key = (spark.sparkContext.applicationId,)
    if key not in _forests:
        _forests[key] = train_forest(labelled_findings(spark))
    return _forests[key]


def scored_candidates(text: Column, path: Column, forest: list[dict]) -> Column:
    """array<struct<found, start, score>>: every candidate of one text, in order of its places."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))
    between = F.split(text, PATTERN, -1)  # one more than there are candidates

    def placed(state: Column, i: Column) -> Column:
        at = state["end"] + F.length(F.get(between, i)) + 1
        return F.struct((at + F.length(F.get(found, i)) - 1).alias("end"), F.array_append(state["starts"], at).alias("starts"))

    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), none, placed, lambda s: s["starts"])

    def valued(x: Column, i: Column) -> Column:
        gap = F.get(between, i)
        before = F.substring(gap, F.greatest(F.length(gap) - NEAR + 1, F.lit(1)), F.lit(NEAR))
        after = F.substring(F.get(between, i + 1), F.lit(1), F.lit(NEAR))
        return F.struct(x.alias("found"), F.get(starts, i).alias("start"), F.array(*features(x, before, after, path)).alias("v"))

    scored = F.transform(
        F.transform(found, valued), lambda x: F.struct(x["found"].alias("found"), x["start"].alias("start"), forest_score(forest, [F.get(x["v"], F.lit(i)) for i in range(len(FEATURES))]).alias("score"))
    )
    return F.when(F.size(found) > 0, scored)


def _rows(docs: DataFrame, findings: DataFrame | None, threshold: float) -> tuple[DataFrame, Column]:
    forest = train_forest(findings) if findings is not None else default_forest(docs.sparkSession)
    scored = scored_candidates(F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("")), forest)
    return docs, F.filter(scored, lambda x: x["score"] >= threshold)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, found, start, score): every place of a secret in every row of ``docs`` (doc_id, text, source, ...).

    ``start`` is its code point in the text, from 1. ``source`` is the path feature; a null
    one is an ordinary path. Texts are read whole, however long. Null and empty texts have no
    findings; a secret that comes again is listed at each place that its neighbours don't
    explain away; a score equal to ``threshold`` counts. Rows that repeat an id, or have
    none, give their own rows. An empty table gives an empty result. Other columns are not read, so
    their names may clash.
    """
    rows, secrets = _rows(docs.select("doc_id", "text", "source"), findings, threshold)
    return rows.select("doc_id", F.explode(secrets).alias("s")).select("doc_id", "s.found", "s.start", "s.score")


def redact_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's value replaced by ``mask``; n_chars, if there, follows the new text. Every row stays.

    A value found secret at one place is replaced at all places. The name in an assignment
    stays; null texts stay null, empty and very long ones are treated alike; repeated rows and rows
    without an id stay; an empty table stays empty.
    """
    rows, secrets = _rows(docs, findings, threshold)
    values = F.array_distinct(F.transform(secrets, lambda x: F.regexp_replace(x["found"], NAME, "")))
    # longest first, so that a secret inside another doesn't break it
    ordered = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    out = rows.withColumn("text", F.aggregate(F.coalesce(ordered, F.array().cast("array<string>")), F.col("text"), lambda t, v: F.replace(t, v, F.lit(mask))))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
