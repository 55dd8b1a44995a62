"""Secret scans: candidates by rule, false positives removed by a random forest, in DataFrame and SQL functions only.

A candidate is a word with a value of 12 or more key characters that holds a digit or symbol, a run of letters alone that is long or cased as words are
not (16 capitals, 16 letters with two changes from small to capital, 28 of any kind), or any value of 6 or more that is
assigned to a credential's name: `name=value` in one word (quotes allowed, as in JSON; a word with several assignments has a finding
for each), or with blanks before or after the sign. Its features are its length, character transitions (classes and common letter pairs),
dictionary coverage, the path it stands in, and the words beside it. The dictionary is the corpus's own: the words that stand in five
documents or more and in a share of them. The forest is trained from labelled findings: any table of that form, or the `findings()` made here by
rule from seeded hashes and words of the dictionary (real keys are not published, so none are copied).

Nulls, ties and odd rows: a null or empty text has no findings; each occurrence is a finding with its word's number; a null
path counts as none; repeated rows are scanned each; redaction meets rows by id and text, so rows of one id (or none) have their own secrets replaced only; other columns are never read; an empty table has no findings; texts of any length are scanned
whole. Words are numbered from 0, white space at the start makes none.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Words by which values are told apart.
CREDENTIAL = "(?i)(key|token|secret|passw|pwd|credential|auth|bearer)"
PLACEHOLDER = "(?i)(example|sample|dummy|your|changeme|placeholder|xxxx|redacted|test)"
REFERENCE = "(?i)^.{0,2}(commit|sha|sha1|sha256|md5|checksum|digest|hash|revision|uuid|id|version|build|isbn|phone|tel)\\W{0,2}$"
COMMON_PAIRS = " th he in er an re nd on en at ou ed ha to or it is hi es ng as te et of al de se le sa si ar ve ra ld ur ei ch un ie ti io ai eu oi au em nt ue ad os ci qu "
#: Letter runs of a value that the dictionary is asked for, and words of the dictionary that labelled findings are made of at most.
RUNS, SAMPLE = "[A-Z]?[a-z]{3,}|[A-Z]{4,}", 500
HEX = "0123456789abcdef"
FEATURES = ("length", "transitions", "digits", "distinct", "common_pairs", "dictionary", "in_path", "odd_place", "credential", "assigned", "placeholder", "reference")

WORD = r"[A-Za-z0-9+/_=.~-]"
#: Key characters in a row, and letters alone that words are hardly made of.
KEY, LETTERS = "[A-Za-z0-9+/_-]{12,}", "[A-Z]{16,}|[A-Za-z]{28,}|(?=[A-Za-z]{16,})[A-Za-z]*[a-z][A-Z][A-Za-z]*[a-z][A-Z]"

#: Assignments: a name, the quotes or brackets that may close it, a sign as a word, a word that starts or ends with one, and
#: where the next assignment of a word starts.
NAME, QUOTES, SIGN, OPENS = r"[A-Za-z_][A-Za-z0-9_.-]{0,60}(?:\x5B[\x22\x27]?[A-Za-z0-9_.-]{1,60})?", r"[\x22\x27\x5D\x5C]*", "^(:?=>?|:)$", "^(:?=>?|:)[^=:/].{5}"
ASSIGNED = CREDENTIAL + r"[A-Za-z0-9_.-]*" + QUOTES + "[=:].{6}"
ENDS = CREDENTIAL + r"[A-Za-z0-9_.-]*" + QUOTES + r"[=:]>?[\x22\x27(]*$"
NEXT = r"[,;&?{]+(?=[\x22\x27]?" + NAME + QUOTES + "[=:](?!//))"


def text_key(text_col: str) -> Column:
    """Tells the rows of one id apart by their texts."""
    return F.xxhash64(F.col(text_col))


def candidates(docs: DataFrame, *, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, text_key, word_no, name, value, before, before2, after, place) of each candidate."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+")
    # short words fail by their length alone; neighbours are looked at for the few that pass
    key = f"w[i] rlike '{KEY}' and (w[i] rlike '[0-9_+/]' or w[i] rlike '{LETTERS}')"
    joined = rf"(instr(w[i], '=') > 0 or instr(w[i], ':') > 0) and w[i] rlike r'{ASSIGNED}'"
    signed = rf"w[i - 1] rlike r'[=:]>?[\x22\x27(]*$' and w[i - 1] rlike r'{ENDS}'"
    apart = rf"i > 0 and ({signed} or w[i] rlike r'{OPENS}' and w[i - 1] rlike r'{CREDENTIAL}') or i > 1 and w[i - 1] rlike r'{SIGN}' and w[i - 2] rlike r'{CREDENTIAL}'"
    test = f"i -> length(w[i]) >= 6 and ((length(w[i]) >= 12 and {key}) or ({joined}) or ({apart}))"
    taken = "i -> struct(i - if(w[0] = '', 1, 0) as word_no, w[i] as word, get(w, i - 1) as before, get(w, i - 2) as before2, get(w, i + 1) as after)"
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), path.alias("place"), F.array(words).alias("t"))
    # the words are bound once as a lambda's variable; a plain column would be split again for each word
    rows = rows.select("id", "text_key", "place", F.expr(f"transform(t, w -> transform(filter(sequence(0, size(w) - 1), {test}), {taken}))[0]").alias("x"))
    rows = rows.select("id", "text_key", "place", F.inline("x"))
    # a word with several assignments, one of them to a credential's name, is parted before each
    several = F.col("word").rlike(ASSIGNED) & F.col("word").rlike(NEXT)
    parts = F.filter(F.split("word", NEXT), lambda w: w.rlike(ASSIGNED) | (w.rlike(KEY) & (w.rlike("[0-9_+/]") | w.rlike(LETTERS))))
    rows = rows.withColumn("word", F.explode(F.when(several, parts).otherwise(F.array("word"))))
    opens = F.col("word").rlike(OPENS) & F.coalesce(F.col("before").rlike(CREDENTIAL), F.lit(False))
    name = F.when(opens, F.regexp_extract("before", r"([A-Za-z_][A-Za-z0-9_.-]{0,60})\W*$", 1)).otherwise(F.regexp_extract("word", rf"^\W*({NAME}){QUOTES}[=:]", 1))
    value = F.regexp_replace(F.regexp_replace("word", rf"^\W*{NAME}{QUOTES}[=:](?!//)", ""), r"^[^A-Za-z0-9+/_~-]+|[^A-Za-z0-9+/_=~-]+$", "")
    return rows.withColumn("name", name).withColumn("value", value).where(F.length("value") >= 6).drop("word")


def dictionary(docs: DataFrame, *, text_col: str = "text", least: int = 5, share: float = 2e-5) -> DataFrame:
    """(word): runs of four letters or more, lower-cased, that stand in at least `least` documents and in this share of all."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return counted.where(F.col("n") >= least).crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("word")


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds covered: how many characters of the value are words of the dictionary. Distinct values meet it, not rows."""
    runs = F.transform(F.regexp_extract_all("value", F.lit(RUNS), F.lit(0)), F.lower)
    parts = found.select("value").distinct().select("value", F.explode(runs).alias("word"))
    sums = parts.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    return found.join(sums, "value", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def measured(found: DataFrame) -> DataFrame:
    """Adds the FEATURES to rows that covered() has seen."""
    v = F.col("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    n = F.length(v)
    near = F.concat_ws(" ", F.when(F.col("before").rlike(SIGN), F.concat_ws(" ", "before2")).otherwise(F.col("before")), "name")
    share = lambda x: x.cast("double") / F.greatest(n, F.lit(1))
    pairs = F.expr(f"size(filter(sequence(1, greatest(length(value) - 1, 1)), i -> instr('{COMMON_PAIRS}', concat(' ', substr(lower(value), i, 2), ' ')) > 0))")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.select(
        "*",
        n.cast("double").alias("length"),
        share(F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1).alias("transitions"),
        share(F.length(F.regexp_replace(v, "[^0-9]", ""))).alias("digits"),
        share(F.size(F.array_distinct(F.split(v, "")))).alias("distinct"),
        share(pairs).alias("common_pairs"),
        share(F.col("covered")).alias("dictionary"),
        yes(v.rlike(r"(^[~.]?/|://|/.*/|\.[a-z]{2,4}$)")).alias("in_path"),
        yes(F.col("place").rlike("(?i)(test|example|sample|mock|fixture|docs?/|lock)")).alias("odd_place"),
        yes(near.rlike(CREDENTIAL)).alias("credential"),
        yes((F.length("name") > 0) | F.col("before").rlike(r"[=:]>?[\x22\x27(]*$")).alias("assigned"),
        yes(F.concat_ws(" ", v, near, "after").rlike(PLACEHOLDER)).alias("placeholder"),
        yes(F.regexp_extract(near, r"(\S*)\s*$", 1).rlike(REFERENCE)).alias("reference"),
    )


def findings(spark: SparkSession, rows: int = 4000, words: list[str] | None = None) -> DataFrame:
    """Labelled findings by rule: keys and short passwords beside credential words; commits, paths, numbers, placeholders and words, also beside such. words:
    some of the dictionary, of which paths and names are made; without any, letters in their place."""
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}-"), F.col("id")), 256)
    base = F.regexp_replace(F.base64(F.unhex(h(1))), "=+$", "")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(names))) + 1).cast("int"))
    made_up = lambda k: F.translate(F.substr(h(k), F.lit(1), F.lit(8)), "0123456789", "thernosial")
    letters = lambda k: pick(words, k + 100) if words else made_up(k)
    word = pick(["the", "of", "is", "and", "with", "see", "from", "for"], 1)
    name = pick(["token", "password", "api_key", "secret", "auth_token", "access_key", "passwd", "client_secret"], 2)
    ref = pick(["commit", "sha256", "md5:", "revision", "uuid", "checksum", "id", "version"], 3)
    size = pick([16, 20, 32, 40, 64], 4)
    short = pick([4, 5, 6, 7, 8], 9)
    none = F.lit("")
    kinds = (
        (1, F.substr(h(0), F.lit(1), size), name, F.lit("=")),
        (1, F.substr(base, F.lit(1), F.least(size, F.lit(40))), name, F.lit("=")),
        (1, F.concat(pick(["AK", "gh_", "sk-", "xo-"], 5), F.substr(base, F.lit(1), F.lit(32))), word, none),
        (1, F.concat(F.substr(base, F.lit(1), F.lit(7)), pick(["!", "#", "-", "_"], 6), F.substr(h(3), F.lit(1), F.lit(4))), name, F.lit("=")),
        (1, base, name, F.lit(":")),
        (0, F.substr(h(0), F.lit(1), size), ref, none),
        (0, F.concat_ws("/", none, letters(5), pick(["src", "lib", "home", "www"], 7), F.concat(letters(6), F.lit(".html"))), word, none),
        (0, F.concat_ws("-", F.substr(F.translate(h(7), "abcdef", "102938"), F.lit(1), F.lit(3)), F.substr(F.translate(h(8), "abcdef", "102938"), F.lit(1), F.lit(3)), F.substr(F.translate(h(9), "abcdef", "102938"), F.lit(1), F.lit(8))), word, none),
        (0, pick(["your_api_key_here", "xxxxxxxxxxxxxxxx", "example_token_123", "changeme_please_1"], 8), name, F.lit("=")),
        (0, F.concat(letters(10), F.lit("_"), letters(11)), word, none),
        (1, F.concat(F.substr(base, F.lit(1), short), F.substr(F.translate(h(12), "abcdef", "102938"), F.lit(1), F.lit(2))), name, F.lit("=")),
        (0, F.rpad(letters(13), 6, "s"), name, F.lit(":")),
        (0, F.initcap(F.rpad(letters(14), 6, "e")), name, F.lit(":")),
        (0, F.concat_ws("-", F.substr(h(15), F.lit(1), F.lit(8)), *(F.substr(h(16), F.lit(1 + 4 * i), F.lit(4)) for i in range(3)), F.substr(h(17), F.lit(1), F.lit(12))), ref, none),
        # letters alone: keys of capitals, and names and long words in the letters of real ones
        (1, F.concat(F.lit("AK"), F.substr(F.translate(h(24), HEX, "QHZNKTPWXJVBGLMD"), F.lit(1), pick([14, 16, 18, 24], 25))), pick(["key", "token", "with", "the"], 26), none),
        (0, F.initcap(F.substr(F.translate(h(27), HEX, "johnsmatrewkiley"), F.lit(1), pick([6, 7, 8, 9], 28))), name, F.lit(":")),
        (0, F.initcap(F.substr(F.translate(h(29), HEX, "enirstadhulcgmof"), F.lit(1), pick([16, 24, 30, 36], 30))), word, none),
        (0, F.upper(F.substr(F.translate(h(31), HEX, "enirstadhulcgmof"), F.lit(1), pick([16, 20, 24, 30], 32))), word, none),
        (0, F.concat(letters(18), F.initcap(letters(19)), F.initcap(letters(20)), pick(["1", "2", "_v3", "_10"], 21)), word, none),
    )
    # where labelled findings stand: placeholders mostly in tests and examples, the others anywhere
    fixtures, sources = ["tests/fixtures/a.json", "docs/example.md", "sample/config.yml", "src/app.py"], ["src/app.py", "conf/live.ini", "web", "deploy/run.sh", "docs/notes.md"]
    place = F.when(F.col("value").rlike(PLACEHOLDER), pick(fixtures, 22)).otherwise(pick(sources, 23))
    every = spark.range(rows).withColumn("kind", F.pmod("id", F.lit(len(kinds))))
    made = F.array(*(F.struct(F.lit(k[0]).alias("label"), k[1].alias("value"), k[2].alias("near"), k[3].alias("sign")) for k in kinds))
    every = every.withColumn("k", F.element_at(made, (F.col("kind") + 1).cast("int"))).select("id", "k.*")
    joined = (F.col("sign") != "") & (F.pmod("id", F.lit(2)) == 0)
    return every.select(
        "label", "value", F.when(joined, F.col("near")).otherwise("").alias("name"),
        F.when(joined, word).when(F.col("sign") != "", F.col("sign")).otherwise(F.col("near")).alias("before"),
        F.when(~joined & (F.col("sign") != ""), F.col("near")).otherwise(word).alias("before2"), word.alias("after"), place.alias("place"),
    )


def train(labelled: DataFrame, words: DataFrame, *, trees: int = 20, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings: label (0 or 1) and the columns of candidates(). The table is meant to be a bounded one."""
    rows = measured(covered(labelled, words)).select(F.col("label").cast("double").alias("label"), *FEATURES).coalesce(2)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", cacheNodeIds=False).fit(vectors)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """One row per candidate: id, text_key (hash of the row's text), word_no, name, value, score, secret."""
    words = C.materialise(dictionary(docs, text_col=text_col), "secret-words")
    if labelled is None:
        some = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()
        labelled = findings(docs.sparkSession, words=[r.word for r in some])
    forest = train(labelled, words)
    found = measured(covered(C.materialise(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col), "secret-candidates"), words))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = forest.transform(vectors).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select(F.col("id").alias(id_col), "text_key", F.col("word_no").cast("bigint").alias("word_no"), "name", "value", "score", (F.col("score") >= least).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every value found to be a secret replaced in its text, the longest first, but not where it is part of a longer word. Findings meet rows by id
    and, where they have a text_key, by text."""
    by_text = "text_key" in findings.columns
    key = F.col("text_key") if by_text else F.lit(0).cast("bigint")
    values = findings.where("secret").groupBy(F.col(id_col).alias("__id"), key.alias("__text")).agg(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value"))).alias("__values"))
    quoted = F.transform("__values", lambda v: F.concat(F.lit("\\Q"), F.replace(v["value"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?<![A-Za-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), (text_key(text_col) if by_text else F.lit(0).cast("bigint")).alias("__key"))
    both = rows.join(values, F.col(f"d.`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")), "left")
    text = F.when(F.col("__values").isNull(), F.col(f"d.`{text_col}`")).otherwise(F.regexp_replace(F.col(f"d.`{text_col}`"), pattern, F.lit(mark)))
    return both.select(*((text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
