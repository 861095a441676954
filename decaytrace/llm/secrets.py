"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything here is DataFrame and SQL functions; the trained forest is compiled into one
column expression that runs inside the projection that found the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import fresh

# Alphabet of a candidate and the blanks that end a word.
CANDIDATE = r"[A-Za-z0-9_+/\-]{12,}={0,2}"
BLANKS = r"[\x20\x09-\x0D]+"

# Words that speak for or against a secret near or in a candidate.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private", "credential", "auth", "bearer")
HARMLESS_WORDS = ("commit", "sha", "md5", "checksum", "hash", "uuid", "guid", "etag", "digest", "revision", "build", "version", "id")
DICTIONARY = (
    "password", "secret", "token", "example", "sample", "changeme", "placeholder", "your", "test", "dummy", "user", "name", "config", "value",
    "default", "file", "page", "index", "image", "video", "data", "model", "server", "client", "report", "release", "best", "guide", "with",
    "from", "that", "this", "and", "the", "for", "key", "api", "new", "how", "ing", "tion", "ment", "der", "ich", "que", "les", "con",
)
COMMON_PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le")
TEST_PATH = "test|example|sample|fixture|mock|docs"

FEATURES = (
    "length", "class_changes", "digits", "capitals", "symbols", "common_pairs", "dictionary", "hex_only", "known_prefix",
    "assigned", "secret_near", "harmless_near", "test_path", "letters_only", "assigned_to_secret",
)

# A name that holds a secret word, what assigns to it, and what may stand around a value.
SECRET_NAME = rf"(?:{'|'.join(SECRET_WORDS)})[A-Za-z0-9_\-]*[\"'\])]*"
ASSIGNS = r"(?:=>|:=|->|[=:])+"
# a value goes on to the next name that is assigned to, or to the end of the word
ASSIGNED = rf"(?i){SECRET_NAME}{ASSIGNS}(.+?)(?=[;,&|][\"']?[A-Za-z_][A-Za-z0-9_\-]*[\"']?[=:]|$)"
NAMES_NEXT = rf"(?i){SECRET_NAME}(?:{ASSIGNS})?$"
JOINS = rf"(?i)^(?:{ASSIGNS}|is|was)$"
PHRASE = rf"""(?i){SECRET_NAME}[ \t]*{ASSIGNS}[ \t]*(?:"[^"\r\n \t]*[ \t][^"\r\n]*"|'[^'\r\n \t]*[ \t][^'\r\n]*')"""


@dataclass(frozen=True)
class Forest:
    """Settings of the random forest and the share of trees that makes a candidate a secret."""

    trees: int = 15
    depth: int = 5
    seed: int = 5
    threshold: float = 0.5


def _any(words: tuple[str, ...]) -> str:
    return "|".join(words)


def features(value: Column, word: Column, before: Column, after: Column, path: Column) -> Column:
    """The features of one candidate as an array of doubles, in the order of ``FEATURES``.

    ``word`` is the whole blank-separated word that holds the candidate, ``before`` and
    ``after`` are its neighbouring words. Nulls count as empty.
    """
    value, word, before, after, path = (F.coalesce(c, F.lit("")) for c in (value, word, before, after, path))
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    changes = F.regexp_count(value, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
    low = F.lower(value)
    lead = F.lower(F.concat(before, F.lit(" "), F.call_function("substring_index", word, value, F.lit(1))))
    near = F.lower(F.concat_ws(" ", before, word, after))

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    made = (
        F.length(value), changes / size, share("[0-9]"), share("[A-Z]"), share("[^A-Za-z0-9]"),
        F.regexp_count(low, F.lit(_any(COMMON_PAIRS))) * 2 / size,
        (F.length(value) - F.length(F.regexp_replace(low, _any(DICTIONARY), ""))) / size,
        value.rlike("^[0-9a-f]+$"), value.rlike("^(AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|AIza|eyJ|glpat)"),
        F.call_function("substring_index", word, value, F.lit(1)).rlike("[=:]"), lead.rlike(_any(SECRET_WORDS)), near.rlike(rf"\b({_any(HARMLESS_WORDS)})\b"),
        F.lower(path).rlike(TEST_PATH), value.rlike("^[A-Za-z]+$"), lead.rlike(rf"""{SECRET_NAME}\s*{ASSIGNS}\s*["'(]*$"""),
    )
    return F.array(*[c.cast("double") for c in made])


def labelled_findings(spark: SparkSession, rows: int = 4_000) -> DataFrame:
    """A bounded table of labelled findings made by rule: value, word, before, after, path, label.

    Every second row is a secret in one of the usual forms, short, punctuated and all-digit
    passwords and passphrases among them; the others are what such patterns also hit: commit
    and content hashes, identifiers, slugs, placeholders, version strings, long words, numbers
    and the words of sentences about passwords and tokens. They are one partition, so that the
    forest's draws do not depend on how many cores a session has.
    """
    n = F.col("id")
    words = F.array(*[F.lit(w) for w in ("north", "lorem", "harbor", "thing", "retion", "stone", "user", "profile", "monthly", "report", "best", "guide")])
    prose = F.array(*[F.lit(w) for w in ("and", "the", "of", "was", "is", "that", "for", "expired", "field", "must", "reset", "manager", "between", "ring", "north", "thorlyedon", "entionre", "policy")])
    marks = F.array(*[F.lit(c) for c in "!.@$%#"])

    def drawn(salt: int, size: int, first: int = 0) -> Column:
        return F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(size)) + first

    def one_of(items: Column, salt: int, size: int) -> Column:
        return F.element_at(items, drawn(salt, size, 1).cast("int"))

    # what many forms share is made once, in projections of its own: the forms below only name it
    base = spark.range(0, rows, 1, 1).withColumn("hexes", F.concat(F.sha2(F.concat(n.cast("string"), F.lit("a")), 256), F.md5(n.cast("string"))))
    base = base.withColumn("coded", F.regexp_replace(F.base64(F.unhex("hexes")), "[=]", ""))
    base = base.withColumns(
        {
            "upper": F.regexp_replace(F.upper("coded"), "[^A-Z2-7]", ""), "plain": F.regexp_replace("coded", "[+/]", ""),
            "number": drawn(9, 9_000, 1_000), "kind": F.pmod(F.floor(n / 2), F.lit(16)), "mark": one_of(marks, 11, 6),
            "some": drawn(12, 4, 6).cast("int"), "digits": F.lpad(drawn(13, 10**15).cast("string"), 15, "7"),  # some: 6 to 9
            "said": one_of(prose, 1, 18), **{f"word_{k}": one_of(words, k, 12) for k in range(1, 7)},
        }
    )
    hexes, coded, upper, plain, number, kind, mark, some, digits, said = (
        F.col(c) for c in ("hexes", "coded", "upper", "plain", "number", "kind", "mark", "some", "digits", "said")
    )

    def word(k: int) -> Column:
        return F.col(f"word_{k}")

    good = n % 2 == 0

    def pick(of_secrets: list[Column], of_others: list[Column]) -> Column:
        out = F.lit(None).cast("string")
        for k in range(16):
            out = F.when(good & (kind == k), of_secrets[k]).when(~good & (kind == k), of_others[k]).otherwise(out)
        return out

    def cut(c: Column, length: int) -> Column:
        return F.substring(c, 1, length)

    slug = F.concat_ws("-", word(1), word(2), word(3), number.cast("string"))
    name = F.concat_ws("_", word(1), word(2), F.concat(F.lit("v"), number.cast("string")))
    guid = F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 12))
    value = pick(
        [F.concat(F.lit("AKIA"), cut(upper, 16)), cut(hexes, 18), cut(hexes, 40), cut(coded, 40), F.concat(F.lit("ghp_"), cut(F.regexp_replace(coded, "[+/]", ""), 36)),
         cut(hexes, 32), cut(F.regexp_replace(coded, "[+/]", ""), 24), F.concat(F.lit("sk_live_"), cut(F.regexp_replace(coded, "[+/]", ""), 24)),
         F.substring(plain, F.lit(1), some), F.concat(cut(plain, 4), mark, F.substring(plain, F.lit(5), some - 3)), F.substring(digits, F.lit(1), some), F.concat_ws(" ", word(1), word(2), word(3), word(6)),
         F.concat(F.lit("AKIA"), cut(F.regexp_replace(upper, "[2-7]", ""), 16)), F.substring(plain, F.lit(1), some), F.concat(cut(word(1), 5), mark, cut(digits, 3)), F.concat(cut(plain, 3), mark, F.substring(plain, F.lit(4), some), mark)],
        [cut(hexes, 40), cut(hexes, 32), guid, slug, name, F.concat(F.lit("your_api_key_"), number.cast("string")), F.concat(word(1), word(2), word(3), number.cast("string")),
         F.concat(F.lit("changeme_example_"), number.cast("string")),
         F.concat(word(1), word(2), word(3)), said, F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3))), F.substring(digits, F.lit(1), some + 6),
         said, F.concat_ws("/", F.lit(""), word(1), word(2), word(3)), F.element_at(F.array(*[F.lit(w) for w in ("changeme", "example", "your_password", "placeholder")]), (number % 4 + 1).cast("int")), F.upper(F.concat_ws("_", word(1), word(2), word(3)))],
    )
    lead = pick(
        [F.lit(""), F.lit("password="), F.lit('"'), F.lit("aws_secret_access_key="), F.lit(""), F.lit("api_key:"), F.lit("pwd="), F.lit('secret:"'),
         F.lit("password="), F.lit('pwd="'), F.lit("passwd:"), F.lit('password="'), F.lit(""), F.lit(""), F.lit("password="), F.lit("secret=")],
        [F.lit(""), F.lit("md5:"), F.lit(""), F.lit("/"), F.lit(""), F.lit("api_key="), F.lit(""), F.lit("password="),
         F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit("password="), F.lit("")],
    )
    before = pick(
        [word(4), word(4), F.lit("token ="), word(4), word(4), word(4), word(4), word(4),
         word(4), word(4), word(4), word(4), word(4), F.lit("the password"), word(4), word(4)],
        [F.lit("in commit"), F.lit("file checksum"), F.lit("request uuid"), word(4), F.concat_ws(" ", F.lit("the"), word(4)), F.lit("set"), word(4), word(4),
         word(4), F.lit("the password"), word(4), F.concat_ws(" ", word(4), F.lit("number")), F.lit("a token"), word(4), word(4), word(4)],
    )
    path = F.when(n % 7 == 0, "docs/example.md").otherwise(F.concat(F.lit("src"), (n % 50).cast("string")))
    return base.select(
        value.alias("value"), F.concat(lead, value).alias("word"), before.alias("before"), word(5).alias("after"), path.alias("path"), good.cast("double").alias("label")
    )


def train(findings: DataFrame, job: Forest = Forest()) -> RandomForestClassificationModel:
    """A random forest over labelled findings (value, word, before, after, path, label).

    The features are written once: training goes over them several times.
    """
    rows = findings.where("label is not null and value is not null").select(
        F.col("label").cast("double").alias("label"), array_to_vector(features(*(F.col(c) for c in ("value", "word", "before", "after", "path")))).alias("features")
    )
    rows = materialize(rows, "findings")
    return RandomForestClassifier(numTrees=job.trees, maxDepth=job.depth, seed=job.seed, minInstancesPerNode=5).fit(rows)


def compiled(model: RandomForestClassificationModel, values: Column) -> Column:
    """The forest as one expression over a feature array: the mean share of secrets in the leaves.

    Every tree is laid out as a complete one, in heap order, in three literal arrays (feature and
    cut of each node, share of each leaf), and walked level by level: the plan does not grow with
    the forest. ``values`` is read at every node, so it should be a column or a lambda's variable.
    """
    roots = [t._call_java("rootNode") for t in model.trees]
    depth = max(1, *(root.subtreeDepth() for root in roots))
    inner = 2**depth - 1
    splits, cuts, leaves = ([x] * (n * len(roots)) for x, n in ((0, inner), (float("inf"), inner), (0.0, inner + 1)))

    def place(tree: int, at: int, node) -> None:
        leaf = node.subtreeDepth() == 0
        if at >= inner:
            harmless, secret = list(node.impurityStats().stats())
            leaves[tree * (inner + 1) + at - inner] = secret / (harmless + secret)
            return
        if not leaf:
            split = node.split()
            splits[tree * inner + at], cuts[tree * inner + at] = int(split.featureIndex()), float(split.threshold())
        place(tree, 2 * at + 1, node if leaf else node.leftChild())
        place(tree, 2 * at + 2, node if leaf else node.rightChild())

    for tree, root in enumerate(roots):
        place(tree, 0, root)

    def constant(numbers: list, kind: str) -> Column:
        return F.split(F.lit(",".join("Infinity" if x == float("inf") else repr(x) for x in numbers)), ",").cast(f"array<{kind}>")

    split_of, cut_of, leaf_of = constant(splits, "int"), constant(cuts, "double"), constant(leaves, "double")

    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            here = tree * inner + at
            return 2 * at + F.when(F.get(values, F.get(split_of, here)) <= F.get(cut_of, here), 1).otherwise(2)

        return F.get(leaf_of, tree * (inner + 1) + F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) - inner)

    shares = F.transform(F.sequence(F.lit(0), F.lit(len(roots) - 1)), leaf)
    return F.aggregate(shares, F.lit(0.0), lambda total, x: total + x) / len(roots)


def with_candidates(docs: DataFrame, model: RandomForestClassificationModel, path_col: str) -> tuple[DataFrame, str]:
    """``docs`` with all candidates of each text as structs (word_no, value, score), in order
    of appearance, in one more column, whose name is returned too.

    A candidate is, within a word, a run of at least twelve letters, digits and ``_ + / -``, or
    whatever is assigned to a name with a secret word or stands next to one, however short; and
    a quoted phrase of several words that is assigned to such a name on one line. Texts without
    any of them cost a pattern test; what a lambda reads of the whole text is a column of the
    projection below it, made once per row.
    """
    words, named, phrases, result = (fresh(docs, c) for c in ("words_of_text", "names_of_text", "phrases_of_text", "candidates_of_text"))
    path = docs[path_col] if path_col in docs.columns else F.lit("")
    of_secrets = F.coalesce(docs["text"].rlike(f"(?i){_any(SECRET_WORDS)}"), F.lit(False))
    text = F.when(of_secrets | F.coalesce(docs["text"].rlike(CANDIDATE), F.lit(False)), docs["text"]).otherwise("")
    empty = F.array().cast("array<string>")
    docs = docs.withColumns({words: F.split(text, BLANKS), phrases: F.when(of_secrets, F.regexp_extract_all(docs["text"], F.lit(PHRASE), F.lit(0))).otherwise(empty)}).withColumn(
        named, F.when(of_secrets, F.transform(words, lambda w: w.rlike(NAMES_NEXT))).otherwise(F.array().cast("array<boolean>"))
    )

    def follows(i: Column) -> Column:
        """Whether word i stands next to a name with a secret word."""
        return F.coalesce(F.get(named, i - 1) | (F.get(named, i - 2) & F.get(words, i - 1).rlike(JOINS)), F.lit(False))

    def suspect(x: Column) -> Column:
        long = (F.length(x["w"]) >= 12) & x["w"].rlike(CANDIDATE)
        return long | ((F.size(named) > 0) & (follows(x["i"]) | x["w"].rlike(ASSIGNED)))

    suspects = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), suspect)

    def of_word(x: Column) -> Column:
        before = F.concat_ws(" ", F.get(F.col(words), x["i"] - 2), F.get(F.col(words), x["i"] - 1))
        after = F.get(F.col(words), x["i"] + 1)
        told = F.regexp_extract_all(x["w"], F.lit(ASSIGNED), F.lit(1))
        next_one = F.when((F.size(told) == 0) & follows(x["i"]) & ~x["w"].rlike(JOINS), F.array(x["w"])).otherwise(empty)
        begins = lambda v: v.rlike("""^["'][^"']*$""") & F.exists(phrases, lambda p: F.contains(p, v))
        bare = F.filter(F.transform(F.filter(F.concat(told, next_one), lambda v: ~begins(v)), _bare), lambda v: v.rlike("[A-Za-z0-9]"))
        runs = F.filter(F.regexp_extract_all(x["w"], F.lit(CANDIDATE), F.lit(0)), lambda v: ~F.exists(bare, lambda b: F.contains(b, v)))
        return F.transform(F.concat(bare, runs), lambda v: F.struct(x["i"].alias("word_no"), v.alias("value"), features(v, x["w"], before, after, path).alias("f")))

    whole = F.when(of_secrets, docs["text"]).otherwise("")

    def of_phrase(found: Column) -> Column:
        """Phrases with the number of the word that their first word is in."""
        between = F.split(whole, PHRASE, -1)

        def placed(m: Column, k: Column) -> Column:
            lead = F.regexp_extract(m, r"""^[^=:>]*[=:>]+[ \t]*["']""", 0)
            told = F.concat(F.array_join(F.zip_with(F.slice(between, 1, k + 1), F.slice(found, 1, k), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""), lead)
            value = F.substring(m, F.length(lead) + 1, F.length(m) - F.length(lead) - 1)
            return F.struct(F.regexp_count(told, F.lit(BLANKS)).cast("int").alias("word_no"), value.alias("value"), features(value, m, F.lit(""), F.lit(""), path).alias("f"))

        return F.transform(found, placed)

    candidates = F.concat(F.flatten(F.transform(suspects, of_word)), of_phrase(F.col(phrases)))
    scored = F.transform(candidates, lambda c: F.struct(c["word_no"], c["value"], compiled(model, c["f"]).alias("score")))
    return docs.withColumn(result, scored).drop(words, named, phrases), result


def _bare(value: Column) -> Column:
    """A value without its quotes, or without the punctuation that ends it."""
    quoted = F.regexp_extract(value, r"""^(["'`])(.+?)\1""", 2)
    return F.when(quoted != "", quoted).otherwise(F.regexp_replace(value, r"""^["'`(<\[{]+|["'`,;:.)\]}>]+$""", ""))


def scan(docs: DataFrame, model: RandomForestClassificationModel, job: Forest = Forest(), path_col: str = "source") -> DataFrame:
    """doc_id, word_no, value, score, is_secret: one row per candidate of every whole text.

    Null and empty texts have no candidates, a null path counts as an empty one, null ids are
    reported with their findings. Repeated rows give repeated findings, a value that stands
    twice in a text gives two. No shuffle; other columns are not read. No rows give no rows.
    """
    wanted = ["doc_id", "text", *([path_col] if path_col in docs.columns else [])]
    found, name = with_candidates(docs.select(*wanted), model, path_col)
    # an outer explode: a filter for texts with candidates would be pushed below and find them twice
    hit = found.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(name).alias("c")).where("c is not null")
    return hit.select("doc_id", F.col("c.word_no").cast("long").alias("word_no"), "c.value", "c.score", (F.col("c.score") >= job.threshold).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel, job: Forest = Forest(), path_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every confirmed secret in ``text`` replaced by ``mark``; rows and columns
    stay, ``n_chars`` (where there is one) follows the new text. Texts without a secret are
    not touched; a null stays null."""
    found, name = with_candidates(docs, model, path_col)
    # longest first: a secret may be part of another
    values = F.transform(F.filter(name, lambda c: c["score"] >= job.threshold), lambda c: F.struct((-F.length(c["value"])).alias("n"), c["value"].alias("v")))
    secrets = fresh(found, "secrets_of_text")
    found = found.withColumn(secrets, F.array_sort(F.array_distinct(values)))
    # a short secret is cut only where it stands alone, not out of longer words
    alone = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    cut = lambda acc, v: F.when(F.length(v) >= 12, F.replace(acc, v, F.lit(mark))).otherwise(F.regexp_replace(acc, alone(v), F.lit(mark)))
    cleaned = F.aggregate(secrets, F.col("text"), lambda acc, s: cut(acc, s["v"]))
    out = {"text": F.when(F.size(secrets) > 0, cleaned).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size(secrets) > 0, F.length(cleaned).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(out).select(*docs.columns)
