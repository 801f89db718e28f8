"""Secret scans with a random forest against false positives, in DataFrame functions only.

Candidates are tokens that look like keys: known key formats, values assigned to a
name such as ``password``, and long mixes of letters and digits. Each is described
by its length, its transitions between kinds of characters, how much of it is made
of dictionary words, its path and the words beside it. A random forest trained on
labelled findings gives the probability that it is a secret; the trees are then
written out as one SQL expression, so scoring is part of the scan's own stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. The words that make up placeholders and identifiers.
WORDS = (
    "about access account action admin after again alert alpha apple array async audit author auth awesome base batch begin black block board book boot border box branch"
    " brand bucket buffer build button byte cache call cancel card case change check child class clean clear click client clock close cloud code color column command commit"
    " common config connect console content context control copy core count create current custom daily dark data date debug default delete demo dependency deploy design"
    " detail device dialog direct disk display document domain draft dummy edit email empty enable entry error event example export factory false feature field file filter"
    " final first fixture flag flow folder font footer form format frame function general global graph green group guide handler hash header health hello help home host icon"
    " image import index info input insert install invalid item java json kernel label large layer layout left level library light line link list load local lock login logic"
    " mail main manager map mark master match media member menu message meta method mobile mock model module month mouse music name native network next node note null number"
    " object offer open option order owner package page panel parent parse part password path pattern phone place placeholder plain player plugin point policy port post"
    " price print private process product profile project proxy public query queue quick random range read record redacted release remote remove report request reset"
    " resource response result return right role root route rule sample save scale scan schema score screen script search secret section secure select send server service"
    " session setting setup shape share short show side sign simple size small snap some sort source space spec stack start state static status step stop storage store stream"
    " string style submit success sync system table target task team temp template test text theme thing this thread time title token tool total track trace train tree true"
    " type under unit update upload user util valid value vector version video view visit wait web week white widget width window with word work world wrap write xxxx year your zone"
).split()
_KEYS = r"(?i)(?<![A-Za-z])(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth[_-]?token)(?![A-Za-z])"
_DECOYS = r"(?i)(?<![A-Za-z])(commit|sha-?(1|256)?|md5|checksum|digest|etag|uuid|guid|hash|revision|blob|build|example|dummy|sample|placeholder|fake|isbn|order|invoice|tracking)(?![A-Za-z])"
_TESTS = r"(?i)(^|[/_.\-])(tests?|examples?|docs?|fixtures?|samples?|mocks?|specs?)([/_.\-]|$)"
_AWS = r"(?<![A-Za-z0-9])A(KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
_JWT = r"(?<![A-Za-z0-9_.\-])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
#: A run of at least 20; it counts if it holds a digit and a letter. Runs are read once, and a name's rest behind its key word up to 64 characters.
_LONG = r"[A-Za-z0-9+/_\-]{20,}+={0,2}"
_VALUE = r"[A-Za-z0-9+/_\-.$@!%&*]{8,}={0,2}"
#: Where a token is cut: before every key name with its sign, so that each has a part of its own.
_NAMED = rf"[\"']?[\w.\-]*{_KEYS.removeprefix('(?i)')}[\w\-]{{0,64}}+[\"']?[:=]"
_PARTS = rf"(?i)&(?={_NAMED})|(?<=[^\w.\-\"'&])(?={_NAMED})"
#: Lines without a match are not looked at further; every candidate needs one of these.
_LINE = rf"[A-Za-z0-9+/_\-]{{20}}|eyJ|(?i:pass|pwd|secret|token|key|credential|auth)[\w\-]{{0,64}}+[\"']?\s*+[:=]"
FEATURES = [
    "length", "transitions", "digits", "uppers", "symbols", "distinct", "covered", "is_hex", "known_form",
    "key_beside", "decoy_beside", "assigned", "test_path", "repeated",
]
TREES, DEPTH, SEED = 24, 6, 42
#: The most labelled findings that the forest is trained on; more are thinned by a hash.
MOST_LABELLED = 20_000
CUTOFF = 0.5


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.lit(1), F.length(text))


def features(found: DataFrame) -> DataFrame:
    """``found`` (value, before, after, path) with a double for each of FEATURES."""
    v, near = F.col("value"), F.concat_ws(" ", "before", "after")
    words = "(?i)(" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[a-z]+", "1"), "[A-Z]+", "2")
    # What is left of each run is one character, so its length counts the runs.
    runs = F.length(kinds)
    made = {
        "length": F.length(v),
        "transitions": (runs - 1) / F.greatest(F.lit(1), F.length(v) - 1),
        "digits": 1 - _share(v, "[0-9]"),
        "uppers": 1 - _share(v, "[A-Z]"),
        "symbols": 1 - _share(v, r"[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.lit(1), F.length(v)),
        "covered": 1 - _share(v, words),
        "is_hex": v.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "known_form": v.rlike(f"{_AWS}|{_JWT}"),
        "key_beside": F.col("before").rlike(_KEYS),
        "decoy_beside": near.rlike(_DECOYS) | v.rlike("(?i)example|changeme|placeholder|xxxx"),
        "assigned": F.col("before").rlike(r"[:=]\s*+[\"']?$"),
        "test_path": F.coalesce(F.col("path"), F.lit("")).rlike(_TESTS),
        "repeated": 1 - _share(v, r"(.)\1{2,}"),
    }
    return found.withColumns({k: c.cast("double") for k, c in made.items()})


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, line_no, token_no, rule, value, before, after) of every candidate in ``docs`` (doc_id, path, text)."""
    lines = docs.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(_LINE))
    # A token with several names, such as minified JSON or a query string, is several parts under one number.
    cut = lambda word, k: F.transform(F.split(word, _PARTS), lambda part: F.struct(k.alias("no"), part.alias("part")))
    parts = F.filter(F.flatten(F.transform(F.split(F.trim("line"), r"\s+"), cut)), lambda x: x["part"] != "")
    lines = lines.select("doc_id", "path", "line_no", parts.alias("parts"))
    # Each part takes its neighbours with it, so that no row carries its whole line.
    span = lambda a, n: F.array_join(F.transform(F.slice("parts", a, n), lambda x: x["part"]), " ")
    beside = lambda at: F.when(at == 0, "").otherwise(span(F.greatest(F.lit(1), at - 2), F.least(at, F.lit(3))))
    told = F.transform("parts", lambda x, at: F.struct(x["no"].alias("token_no"), x["part"].alias("token"), beside(at).alias("ahead"), span(at + 2, F.lit(3)).alias("after")))
    near = lines.select("doc_id", "path", "line_no", F.explode(told).alias("x")).select("doc_id", "path", "line_no", "x.*")
    token = F.col("token")
    # name=value in one token is cut at the sign; a value alone looks to the words before it.
    inner = F.regexp_extract(token, r"^(.*?[:=])[\"']?[^\s\"']+", 1)
    shown = F.when((inner != "") & inner.rlike(_KEYS), F.substring(token, F.length(inner) + 1, F.length(token))).otherwise(token)
    near = near.withColumns({"shown": shown, "before": F.concat_ws(" ", "ahead", F.when(shown != token, inner))})
    shown, before = F.col("shown"), F.col("before")
    # Every match is a candidate; what one rule has taken is not read by the next.
    aws, jwt = (F.regexp_extract_all(shown, F.lit(p), F.lit(0)) for p in (_AWS, _JWT))
    rest = F.regexp_replace(shown, f"{_AWS}|{_JWT}", " ")
    assigned = F.when(before.rlike(_KEYS.replace("(?![A-Za-z])", "") + r"[\w\-]{0,64}+[\"']?\s*+[:=]\s*+[\"']?$"), F.regexp_extract(rest, _VALUE, 0)).otherwise("")
    near = near.withColumns({"aws": aws, "jwt": jwt, "assigned": assigned, "rest": rest})
    left = F.when(F.col("assigned") != "", F.replace(F.col("rest"), F.col("assigned"), F.lit(" "))).otherwise(F.col("rest"))
    named = lambda values, rule: F.transform(values, lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))
    every = F.concat(
        named(F.col("aws"), "access key"),
        named(F.col("jwt"), "web token"),
        named(F.filter(F.array("assigned"), lambda v: v != ""), "assignment"),
        named(F.filter(F.regexp_extract_all(left, F.lit(_LONG), F.lit(0)), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")), "mixed string"),
    )
    found = near.select("doc_id", "path", "line_no", "token_no", "before", "after", F.explode(every).alias("x"))
    return found.select("doc_id", "path", "line_no", "token_no", "x.rule", "x.value", "before", "after")


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled findings (value, before, after, path, label) made by rule: real formats, and what is usually mistaken for them.

    A stand-in for reviewed findings, which ``train`` takes in the same form.
    """
    row = spark.range(0, n, 1, 4)
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id").cast("string")), 256)
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(xs))) + 1).cast("int"))
    base = F.regexp_replace(F.base64(F.unhex(h(1))), "=", "")
    upper = F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(h(2))), "[^A-Za-z0-9]", "")), 1, 16)
    hexes = F.substring(h(3), 1, pick(4, 18, 24, 32, 40))
    word = lambda k: pick(k, *WORDS)
    key = pick(5, "password=", "token =", "secret:", "api_key =", "the access_key =", "auth_token=", 'password = "')
    prose = pick(6, "and the", "of this to", "see", "with", "is in the")
    junk = F.concat(word(29), pick(30, "$$$", "%%%", "###", "&&&", "***"))
    kinds = [
        (1, F.concat(F.lit("AKIA"), upper), prose, prose),
        (1, F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(base, 1, 17)), F.concat(F.lit("eyJ"), F.substring(h(27), 1, pick(28, 20, 40))), F.substring(base, 3, 30)), prose, prose),
        (1, hexes, key, prose),
        (1, hexes, F.concat_ws(" ", junk, key), F.concat_ws(" ", junk, prose)),
        (1, F.substring(base, 1, pick(7, 20, 32, 40)), key, prose),
        (1, F.concat(F.substring(h(8), 1, 6), F.upper(F.substring(h(9), 1, 6))), key, prose),
        (0, F.concat(F.lit("AKIA"), F.substring(upper, 1, 9), F.lit("EXAMPLE")), prose, prose),
        (0, F.substring(h(10), 1, pick(11, 32, 40, 64)), pick(12, "commit", "sha256:", "md5 checksum", "etag:", "the build hash is"), prose),
        (0, F.concat_ws("-", F.substring(h(13), 1, 8), F.substring(h(13), 9, 4), F.substring(h(13), 13, 4), F.substring(h(13), 17, 12)), pick(14, "uuid", "guid =", "order", "see"), prose),
        (0, F.concat_ws("_", word(15), word(16), word(17), pick(18, "1", "v2", "2024")), prose, prose),
        (0, F.concat_ws("", word(19), pick(20, "123", "1", "2024", "changeme", "placeholder")), key, prose),
        (0, F.concat_ws("/", word(21), word(22), F.concat(word(23), F.lit("2.html"))), pick(24, "in", "path:", "see", "file ="), prose),
        (0, F.repeat(pick(25, "x", "0", "a1", "X"), 12), key, prose),
    ]
    part = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda k: F.coalesce(*(F.when(part == i, F.lit(x[k]) if isinstance(x[k], int) else x[k]) for i, x in enumerate(kinds)))
    path = pick(26, "src/main", "tests/unit", "docs/guide", "config", "web/pages", "examples")
    return row.select(choose(1).alias("value"), choose(2).alias("before"), choose(3).alias("after"), path.alias("path"), choose(0).alias("label"))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Column:
    """The forest's probability that a candidate is a secret, as an expression over FEATURES.

    Trained on at most MOST_LABELLED findings. Of one label only, the probability
    is that label; of none, 1: nothing is then taken for a false positive.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labelled.where("label is not null and value is not null")
    total = known.count()
    share = F.lit(min(1.0, MOST_LABELLED / max(1, total)) * (1 << 20))
    known = known.where(F.pmod(F.xxhash64("value", "before", "after"), F.lit(1 << 20)) < share)
    labels = [r[0] for r in known.select("label").distinct().collect()]  # two at most
    if len(labels) < 2:
        return F.lit(float(labels[0]) if labels else 1.0)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(known).withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(rows)

    def written(node) -> Column:
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(stats[1] / sum(stats))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= split.threshold(), written(node.leftChild())).otherwise(written(node.rightChild()))

    votes = [written(t._call_java("rootNode")) for t in forest.trees]
    return sum(votes[1:], votes[0]) / len(votes)


def scan(docs: DataFrame, labelled: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Every candidate of ``docs`` (doc_id, path, text) with its probability, and whether it is kept.

    Columns doc_id, line_no, token_no, rule, value, probability, kept. Null and
    empty texts have no candidates; a null path is no test path. Repeated rows
    each return theirs. Texts and lines may have any length. Other columns are
    not read; no rows give no rows.
    """
    probability = train(labelled)
    found = features(candidates(docs)).withColumn("probability", F.round(probability, 6))
    return found.select("doc_id", "line_no", "token_no", "rule", "value", "probability", (F.col("probability") >= cutoff).alias("kept"))
