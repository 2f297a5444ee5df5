"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

All of it is column functions on each document's row: a list of candidates, their features, and the
forest's trees as one SQL expression.  The forest is grown by Spark on labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodstream.llm.shared import held_out

#: Labelled findings that the forest is grown on, of each kind.
FIT_ROWS = 10_000
TREES, DEPTH = 20, 5
#: Words found in the most documents; together they are the dictionary.
DICTIONARY = 3000
CUT = 0.5
MASK = "[SECRET]"

NAMES = r"secret|token|passw|pwd|api.?key|access.?key|auth|credential|private|bearer"
#: Ends a value only where the text goes on without it: at a space, the end, another mark or the next name.
_MARK = r"[.,;&)\]}](?=[\s.,;&)\]}\"'`]|$|[A-Za-z_][\w-]{0,64}\s{0,4}[=:])"
#: A key block, a value given to something named a secret, a quoted value, or a run of key characters with a digit in
#: it and at most padding behind.  None has a longest length; the possessive loops don't recurse on long texts.
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{3,40}-----(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{3,40}-----"
    r"|(?<=[=:>][\s\"'`]{0,5})(?=[^\s\"'`=:<>-])"
    rf"(?<=(?i:{NAMES})[\w-]{{0,24}}[\"'`]?\s{{0,4}}(?:=>|[=:]{{1,2}})\s{{0,4}}[\"'`]?)(?:(?!{_MARK})[^\s\"'`<>]){{4,}}+"
    r"|(?<=[\"'])[^\s\"']{8,}+(?=[\"'])"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?+"
)
KEY_WORD = rf"(?i)({NAMES})[^\n]{{0,24}}$"
_DUMMY = r"(?:example|sample|dummy|placeholder|changeme|your|x{4,}|test)"
#: A stand-in word, whole, in the value, or in the name right before it.
DUMMY_VALUE = rf"(?i)(?<!\p{{L}}){_DUMMY}(?!\p{{L}})|^1234567890"
DUMMY_NAME = rf"(?i)(?<!\p{{L}}){_DUMMY}(?!\p{{L}})[\w-]{{0,40}}[\"'`]?\s{{0,4}}(?:=>|[=:]{{0,2}})\s{{0,4}}[\"'`]?$"
#: Values that are secrets by their own form: private key blocks and tokens with a known beginning.
SURE = (
    r"^-----BEGIN [A-Z0-9 ]*PRIVATE KEY|^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$"
    r"|^github_pat_[A-Za-z0-9_]{22,}$|^glpat-[A-Za-z0-9_-]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$"
    r"|^[sr]k_live_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$|^npm_[A-Za-z0-9]{36}$"
    r"|^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+$"
)
#: What stands right before the password of an address.
IN_ADDRESS = r"://[^\s/:@]{0,64}:$"
#: A value that names where a secret is kept instead of being one; its last bracket may have been cut off as a mark.
REFERENCE = r"^(?:\$\{[A-Za-z_][\w.:-]*\}?|\$\([A-Za-z_][\w.: -]*\)?|\{\{.*\}\}|\$[A-Z_][A-Z0-9_]*|%[A-Za-z_][A-Za-z0-9_]*%)$"
#: Such tokens need no digit to be candidates; a signed token is one candidate with its dots, and so is the password of
#: an address, up to the last @ before the host.
_TOKENS = (
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?+"
    r"|(?<=:)(?=[^\s/@:\"'<>]{3,200}@)(?<=://[^\s/:@]{0,64}:)[^\s/@:\"'<>]++(?=@)|"
    r"(?<![A-Za-z0-9_+/-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|npm_[A-Za-z0-9]{36}"
    r"|[sr]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}+|glpat-[A-Za-z0-9_-]{20,}+)"
    r"(?![A-Za-z0-9_+/-])"
)
CANDIDATE = f"{_TOKENS}|{CANDIDATE}"

FEATURES = [
    "length", "digits", "capitals", "turns", "case_turns", "distinct", "hex", "cover", "path_depth", "path_test",
    "key_word", "assigned", "quoted", "dummy", "before", "after", "sure", "mixed",
]


def dictionary(frame: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` words of three to ten letters that are in the most rows; fewer if there are fewer."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    counted = frame.select(F.explode(words).alias("word")).where(F.length("word").between(3, 10))
    top = counted.groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(size)
    return [row["word"] for row in top.collect()]


def candidates(text: str, path: str, words: list[str]) -> Column:
    """Candidates of a text: start (code points from 0), value and features.

    The gaps before each candidate are captured with it, so that starts are running sums.  The 60
    characters before a candidate reach into the candidates before it, as a value's name may be one.
    """
    split = rf"(?s)\G(.*?)({CANDIDATE})"  # \G: behind the last candidate the search ends at once
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(split), F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, F.lit(split), F.lit(2)).alias("value"),
    )

    def before(done: Column, pair: Column) -> Column:
        return F.right(F.concat(done["tail"], F.right(pair["gap"], F.lit(60))), F.lit(60))

    begin = F.expr("struct(0L as upto, '' as tail, cast(array() as array<struct<start:bigint,value:string,gap:string>>) as found)")
    located = F.aggregate(
        pairs, begin,
        lambda done, pair: F.struct(
            (done["upto"] + F.length(pair["gap"]) + F.length(pair["value"])).alias("upto"),
            F.right(F.concat(before(done, pair), F.right(pair["value"], F.lit(60))), F.lit(60)).alias("tail"),
            F.concat(done["found"], F.array(F.struct(
                (done["upto"] + F.length(pair["gap"])).alias("start"), pair["value"].alias("value"),
                before(done, pair).alias("gap"),
            ))).alias("found"),
        ),
        lambda done: done["found"],
    )
    some = F.filter(F.when(F.col(text).rlike(CANDIDATE), located), lambda c: ~c["value"].rlike(REFERENCE))
    return F.transform(some, lambda c: F.struct(
        c["start"].alias("start"), F.length(c["value"]).cast("long").alias("length"), c["value"].alias("value"),
        _features(c, F.col(text), F.coalesce(F.col(path).cast("string"), F.lit("")), words).alias("features"),
    ))


def _features(c: Column, text: Column, path: Column, words: list[str]) -> Column:
    value, gap = c["value"], c["gap"]
    size = F.length(value)

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    runs = F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda run: (F.length(run) >= 3) & run.isin(words or [""]))
    covered = F.aggregate(runs, F.lit(0), lambda sum_, run: sum_ + F.length(run))
    follows = F.substring(text, (c["start"] + 1 + size).cast("int"), F.lit(20))
    values = {
        "length": size,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "turns": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
        "case_turns": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hex": value.rlike("^[0-9a-fA-F]+$"),
        "cover": covered / size,
        "path_depth": F.regexp_count(path, F.lit("[/\\\\]")),
        "path_test": path.rlike("(?i)test|example|sample|mock|fixture|doc"),
        "key_word": gap.rlike(KEY_WORD),
        "assigned": gap.rlike("[=:]\\s*[\"'`]?$"),
        "quoted": gap.rlike("[\"'`]$"),
        "dummy": value.rlike(DUMMY_VALUE) | gap.rlike(DUMMY_NAME),
        "before": F.length(F.regexp_extract(gap, r"(\p{L}+)[^\p{L}]*$", 1)),
        "after": F.length(F.regexp_extract(follows, r"^[^\p{L}]*(\p{L}+)", 1)),
        "sure": (value.rlike(SURE) | gap.rlike(IN_ADDRESS)) & ~value.rlike(DUMMY_VALUE),
        "mixed": value.rlike("[^A-Za-z]|[a-z][A-Z]"),
    }
    return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])


def findings(frame: DataFrame, id_column: str, text: str, path: str, words: list[str]) -> DataFrame:
    """One row per candidate: id, start, length, value and features."""
    exploded = frame.select(id_column, F.explode(candidates(text, path, words)).alias("c"))
    return exploded.select(id_column, "c.*")


def likely(features: Column) -> Column:
    """A label for findings nobody has looked at: a secret by its form, or a varied value given to something
    named a secret; a short one is quoted or holds more than a word.
    """
    named = (
        (features["key_word"] == 1) & (features["assigned"] == 1) & (features["dummy"] == 0)
        & (features["distinct"] >= 0.15)
        & ((features["length"] >= 12) | (features["quoted"] == 1) | (features["mixed"] == 1))
    )
    return (named | (features["sure"] == 1)).cast("double")


def grow(labelled: DataFrame, rows: int = FIT_ROWS, seed: int = 7) -> str | None:
    """The forest grown on findings with ``label`` 0 or 1, as SQL over a struct named ``f``.

    At most ``rows`` findings of each label count, chosen by a hash of their values.  None if there
    are not findings of both kinds.
    """
    flat = labelled.select("label", "value", "start", *[F.col(f"features.{name}").alias(name) for name in FEATURES])
    parts = [
        flat.where(F.col("label") == kind).orderBy(F.xxhash64("value", "start"), "value", "start").limit(rows)
        for kind in (0.0, 1.0)
    ]
    # the two bounded samples are read by the forest several times
    sample = parts[0].unionByName(parts[1]).cache()
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        ready = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample)
        forest = RandomForestClassifier(
            featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt"
        )
        model = forest.fit(ready)
        trees = [_tree(tree._call_java("rootNode")) for tree in model.trees]
        return f"({' + '.join(trees)}) / {len(trees)}"
    finally:
        sample.unpersist()


def _tree(node) -> str:
    """A tree as SQL: the share of secrets in the leaf that the features lead to."""
    if node.getClass().getSimpleName() == "LeafNode":
        clean, secret = node.impurityStats().stats()
        return f"{secret / (clean + secret)!r}D"
    split = node.split()
    name = FEATURES[split.featureIndex()]
    return f"if(f.{name} <= {split.threshold()!r}D, {_tree(node.leftChild())}, {_tree(node.rightChild())})"


def scan(
    frame: DataFrame, forest: str | None, words: list[str], text: str = "text", path: str = "source"
) -> DataFrame:
    """``frame`` with ``secrets``: start, length, value and score of every finding above the cut.

    Whole texts are searched, row by row, without a shuffle.  Null and empty texts have no secrets
    (an empty list); a null path counts as empty.  A secret by its own form needs no forest, which may
    have seen none of its kind.  Without a forest the label rule decides.
    """
    score = "if(f.key_word = 1 and f.assigned = 1 and f.dummy = 0, 1D, 0D)" if forest is None else forest
    score = f"if(f.sure = 1, 1D, {score})"
    found = frame.drop("secrets").withColumn("_found", candidates(text, path, words))
    scored = F.expr(
        "transform(_found, c -> struct(c.start as start, c.length as length, c.value as value, "
        f"element_at(transform(array(c.features), f -> {score}), 1) as score))"
    )
    kept = F.filter(scored, lambda c: c["score"] >= CUT)
    nothing = F.expr("cast(array() as array<struct<start:bigint,length:bigint,value:string,score:double>>)")
    return found.withColumn("secrets", F.coalesce(kept, nothing)).drop("_found")


def redact(frame: DataFrame, text: str = "text") -> DataFrame:
    """``frame`` with every secret in its text replaced by a mark; ``secrets`` as ``scan`` gives them.

    From the last to the first, so that the starts hold.
    """
    masked = F.aggregate(
        F.reverse("secrets"), F.col(text),
        lambda done, c: F.concat(
            F.substring(done, F.lit(1), c["start"].cast("int")), F.lit(MASK),
            F.substring(done, (c["start"] + c["length"] + 1).cast("int"), F.length(done)),
        ),
    )
    return frame.withColumn(text, masked)


def fit(documents: DataFrame, path: str = "source") -> tuple[str | None, list[str]]:
    """Forest and dictionary of documents (``doc_id``, ``text`` and a path).

    The dictionary counts all documents; the labelled findings come from those not held out.
    """
    words = dictionary(documents)
    found = findings(documents.where(~held_out()), "doc_id", "text", path, words)
    return grow(found.withColumn("label", likely(F.col("features")))), words


def scan_documents(documents: DataFrame) -> DataFrame:
    """Every secret of every document: id, start, length, score and the value's hash."""
    forest, words = fit(documents)
    found = scan(documents.select("doc_id", "source", "text"), forest, words)
    return found.select("doc_id", F.explode("secrets").alias("s")).select(
        "doc_id", "s.start", "s.length", "s.score", F.sha2("s.value", 256).alias("value_sha256")
    )
