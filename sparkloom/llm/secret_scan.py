"""Secret scans whose false positives a random forest removes. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut

#: A candidate: a run of 16 or more characters that keys are made of, in one word of the text.
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Words beside a candidate that speak for and against a secret (fixed values).
FOR_WORDS = r"(?i)token|secret|passw|passphrase|api.?key|apikey|access.?key|auth|bearer|credential|private"
AGAINST_WORDS = r"(?i)commit|sha\d*|md5|checksum|digest|hash|uuid|guid|revision|etag|example|sample|http|www|file|path|version"
TEST_PATH = r"(?i)test|spec|doc|example|fixture|sample"
#: The dictionary: letter triples of the commonest words of the corpus; a parameter says how many words, this is its default.
DICTIONARY_WORDS = 5000

FEATURES = ("length", "digits", "uppers", "symbols", "to_digit", "from_digit", "case_changes", "kinds", "hexadecimal", "coverage", "longest_letters", "for_word", "against_word", "assigned", "quoted", "test_path")
DEPTH, TREES = 5, 12


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, at, candidate, word, before, after, path): one row per candidate of the whole text.

    `at` is the number of the word in the text, `before` the two words ahead of it, `after` the next one.
    """
    text = F.col(text_col)
    words = F.split(text, r"[\x20\x09-\x0D]+")
    docs = docs.where(text.rlike(CANDIDATE)).select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"), (F.col(path_col) if path_col else F.lit(None)).cast("string").alias("path"))
    found = F.filter(F.transform("words", lambda w, i: F.when(F.length(w) >= 16, F.struct(i.alias("at"), F.regexp_extract_all(w, F.lit(CANDIDATE), F.lit(0)).alias("c")))), lambda x: F.size(x["c"]) > 0)
    rows = docs.select("doc_id", "words", "path", F.explode(found).alias("f"))
    word = lambda d: F.coalesce(F.try_element_at("words", F.col("f.at") + d + 1), F.lit(""))
    before = F.concat_ws(" ", F.when(F.col("f.at") >= 2, F.get("words", F.col("f.at") - 2)), F.when(F.col("f.at") >= 1, F.get("words", F.col("f.at") - 1)))
    rows = rows.select("doc_id", "path", F.col("f.at").alias("at"), word(0).alias("word"), before.alias("before"), word(1).alias("after"), F.posexplode("f.c").alias("nth", "candidate"))
    return rows.select("doc_id", "at", "nth", "candidate", "word", "before", "after", "path")


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> DataFrame:
    """One row, `triples`: which letter triples the `most` commonest words of 4 to 12 lower-case letters have, as 26 ** 3
    bytes, so that a look-up costs the same however many there are."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![A-Za-z0-9])[a-z]{4,12}(?![A-Za-z0-9])"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    triples = top.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("t")).distinct()
    every = docs.sparkSession.range(26**3).join(triples.select(_place(F.col("t")).cast("long").alias("id"), F.lit("01").alias("bit")), "id", "left")
    bits = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bit", F.lit("00")).alias("bit")))), lambda x: x["bit"])
    return every.agg(F.unhex(F.array_join(bits, "")).alias("triples"))


def _place(triple: Column) -> Column:
    """Number of a triple of lower-case letters, from 0."""
    letter = lambda i: F.ascii(F.substring(triple, i, 1)) - 97
    return letter(1) * 676 + letter(2) * 26 + letter(3)


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the features; `words` is the one row of `dictionary` (26 ** 3 bytes, so it may be broadcast)."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c)
    count = lambda pattern, x=c: F.regexp_count(x, F.lit(pattern))
    share = lambda x: x / n
    chars = F.split(c, "")
    triples = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    covered = F.size(F.filter(triples, lambda t: t.rlike("^[a-z]{3}$") & (F.substring(F.col("triples"), _place(t) + 1, F.lit(1)) == F.lit(b"\x01"))))
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]*"), F.lit(0)), lambda x: F.length(x)))
    columns = {
        "length": F.least(n, F.lit(256)),
        "digits": share(count("[0-9]")),
        "uppers": share(count("[A-Z]")),
        "symbols": share(count(r"[+/_\-=]")),
        "to_digit": share(count("[A-Za-z](?=[0-9])")),
        "from_digit": share(count("[0-9](?=[A-Za-z])")),
        "case_changes": share(count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")),
        "kinds": F.size(F.array_distinct(chars)) / F.least(n, F.lit(40)),
        "hexadecimal": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "coverage": covered / F.size(triples),
        "longest_letters": F.coalesce(longest, F.lit(0)) / n,
        "for_word": F.col("before").rlike(FOR_WORDS).cast("int") + F.col("word").rlike(FOR_WORDS).cast("int"),
        "against_word": F.col("before").rlike(AGAINST_WORDS).cast("int") + F.col("word").rlike(AGAINST_WORDS).cast("int"),
        "assigned": (F.concat_ws(" ", "before", "word").rlike(r"[=:]")).cast("int"),
        "quoted": F.col("word").rlike("[\"'`]").cast("int"),
        "test_path": F.coalesce(F.col("path"), F.lit("")).rlike(TEST_PATH).cast("int"),
    }
    kept = found.join(F.broadcast(words))
    return kept.select(*found.columns, *[columns[k].cast("double").alias(k) for k in FEATURES])


@dataclass
class Node:
    """A split (feature, least value that goes right) or a leaf (share of secrets)."""

    share: float
    feature: str | None = None
    value: float = 0.0
    left: Node | None = field(default=None)
    right: Node | None = field(default=None)

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.share)
        return F.when(F.col(self.feature) >= self.value, self.right.column()).otherwise(self.left.column())


def best_split(table: dict[str, dict[int, tuple[int, int]]], features: list[str], n: int, pos: int) -> tuple[str, int] | None:
    """The feature and least bin on the right that lower the Gini impurity most; ties go to the first feature, then the
    lowest bin. `table`: feature -> bin -> (weight, weight of secrets) of a node with weight n, pos of it secrets. None
    where no split lowers it."""
    before, found = pos * pos / n + (n - pos) ** 2 / n, None
    for k in features:
        left = left_pos = 0
        for b in range(max(table[k]) + 1):
            if 0 < left < n:
                right, right_pos = n - left, pos - left_pos
                purity = (left_pos**2 + (left - left_pos) ** 2) / left + (right_pos**2 + (right - right_pos) ** 2) / right
                if purity > before + 1e-9 and (found is None or purity > found[0] + 1e-12):
                    found = (purity, k, b)
            w = table[k].get(b, (0, 0))
            left, left_pos = left + w[0], left_pos + w[1]
    return found and found[1:]


def train_forest(labelled: DataFrame, *, trees: int = TREES, depth: int = DEPTH, bins: int = 16) -> list[Node]:
    """A random forest over featured findings with a boolean `is_secret`.

    Every tree sees each finding with a Poisson weight and, at each node, a random half of the features, both
    from hashes, so that runs agree. A level of all trees is one aggregation: weights by (tree, node, feature,
    bin); what comes to the driver is bounded by trees x nodes x features x bins. Bins are quantiles of the
    training findings. Splits take the largest drop of the Gini impurity, ties by feature and bin.
    """
    cuts = labelled.agg(*[F.percentile(k, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias(k) for k in FEATURES]).first()
    edges = {k: sorted(set(cuts[k] or [])) for k in FEATURES}
    binned = {k: sum((F.when(F.col(k) >= e, 1).otherwise(0) for e in edges[k]), F.lit(0)) for k in FEATURES}
    u = F.pmod(F.xxhash64("__row", "tree"), F.lit(10_000)) / 10_000.0
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in (0.3679, 0.7358, 0.9197, 0.981)), F.lit(0))
    rows = labelled.withColumn("__row", F.xxhash64("candidate", "before", "after", *FEATURES))
    rows = rows.select("__row", F.col("is_secret").cast("int").alias("y"), F.array(*[binned[k] for k in FEATURES]).alias("bins"))
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", weight).where("w > 0").withColumn("node", F.lit(1))
    rows = cut(rows.drop("__row"))
    nodes: dict[tuple[int, int], Node] = {}
    splits: dict[tuple[int, int], tuple[str, int]] = {}
    for level in range(depth + 1):
        if level:  # one step down; rows in leaves are done
            last = [(t, node, FEATURES.index(k), b) for (t, node), (k, b) in splits.items() if node.bit_length() == level]
            if not last:
                break
            steps = F.broadcast(labelled.sparkSession.createDataFrame(last, "tree int, node int, feature int, least int"))
            down = F.col("node") * 2 + (F.get("bins", F.col("feature")) >= F.col("least")).cast("int")
            rows = cut(rows.join(steps, ["tree", "node"]).withColumn("node", down).drop("feature", "least"))
        long = rows.select("tree", "node", "w", "y", F.posexplode("bins").alias("feature", "bin"))
        sums = long.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos")).collect()
        tables: dict[tuple[int, int], dict[str, dict[int, tuple[int, int]]]] = {}
        for r in sums:
            tables.setdefault((r["tree"], r["node"]), {}).setdefault(FEATURES[r["feature"]], {})[r["bin"]] = (r["n"], r["pos"])
        for (t, node), table in sorted(tables.items()):
            n, pos = (sum(v[i] for v in table[FEATURES[0]].values()) for i in (0, 1))
            nodes[t, node] = Node((pos + 0.5) / (n + 1))
            if level == depth or pos in (0, n) or n < 8:
                continue
            some = [k for i, k in enumerate(FEATURES) if (hash((t, node, i)) * 2654435761 >> 7) % 2]
            if best := best_split(table, some, n, pos):
                splits[t, node] = best
    for (t, node), (k, b) in splits.items():
        if (t, 2 * node) in nodes and (t, 2 * node + 1) in nodes:
            own = nodes[t, node]
            own.feature, own.value, own.left, own.right = k, edges[k][b - 1], nodes[t, 2 * node], nodes[t, 2 * node + 1]
    return [nodes[t, 1] for t in range(trees) if (t, 1) in nodes]


def synthetic_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """`n` labelled findings made from hashes: keys in assignments, and what looks like keys but is none."""
    r = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 512).alias("h"), F.pmod(F.xxhash64("id"), F.lit(14)).alias("kind"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(6)).cast("int").alias("v"))
    b64 = F.translate(F.base64(F.unhex(F.substring("h", 1, 96))), "=", "")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.pmod("v", F.lit(len(xs))) + 1)
    name = pick("token", "api_key", "secret", "password", "auth_token", "access_key")
    syllables = F.array(*[F.lit(x) for x in ("the", "ing", "tion", "er", "an", "schaft", "mente", "eaux", "re", "st", "der", "que", "ion", "lich", "ado", "ent")])
    invented = F.array_join(F.transform(F.sequence(F.lit(1), F.col("v") + 6), lambda i: F.element_at(syllables, F.conv(F.substring(F.col("h"), i, F.lit(1)), 16, 10).cast("int") + 1)), "")
    hex_ = F.substring(F.col("h"), F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), F.pmod("v", F.lit(3)) + 1))
    number = F.substring(F.translate(F.col("h"), "abcdef", "314159"), F.lit(1), F.col("v") + 16)
    groups = F.concat_ws("-", *[F.substring(number, i, 4) for i in (1, 5, 9, 13)])
    uuid = F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12))
    cases = [
        (True, hex_, F.concat(name, F.lit(" =")), '"{}"'), (True, F.upper(hex_), F.concat(F.upper(name), F.lit(" =")), '"{}"'),
        (True, F.substring(b64, 1, 40), F.concat(name, F.lit(":")), "'{}'"), (True, F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16))), F.concat(F.lit("uses "), name), "{}"),
        (True, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.lit("export X ="), "{}"), (True, F.concat(F.lit("sk-"), F.substring(b64, 1, 44)), F.lit("Authorization: Bearer"), "{}"),
        (False, hex_, pick("commit", "sha256 sum", "checksum:", "md5", "digest", "in revision"), "{}"), (False, uuid, pick("request uuid", "id:", "guid", "with the", "session", "see"), "{}"),
        (False, invented, pick("of the", "with", "and der", "que la", "in", "to"), "{}"), (False, F.concat(F.lit("/usr/share/"), invented), pick("file", "path", "in", "under", "see", "http"), "{}"),
        (False, F.concat_ws("_", pick("my", "the", "some", "test", "get", "set"), invented), F.concat(name, F.lit(" =")), "{}"), (False, F.rpad(F.lit("x"), F.col("v") + 16, "x"), F.concat(name, F.lit(" =")), '"{}"'),
        (False, number, pick("of the", "card", "number", "und der", "account no", "with"), "{}"), (False, groups, pick("paid by", "card:", "isbn", "the", "call", "no"), "{}"),
    ]
    k = F.col("kind")
    of = lambda i: F.coalesce(*[F.when(k == j, c[i] if i != 3 else F.lit(c[3])) for j, c in enumerate(cases)])
    r = r.select("v", k, F.coalesce(*[F.when(k == j, F.lit(c[0])) for j, c in enumerate(cases)]).alias("is_secret"), of(1).alias("candidate"), of(2).alias("before"), of(3).alias("frame"))
    return r.select("is_secret", "candidate", F.replace(F.col("frame"), F.lit("{}"), F.col("candidate")).alias("word"), "before", pick("and", "of", "", "the", "in", "de").alias("after"), pick("src/a", "conf/b", "tests/c", "docs/d", "src/e", "lib/f").alias("path"))


def score(found: DataFrame, forest: list[Node]) -> Column:
    """Mean share of secrets over the trees."""
    return sum((t.column() for t in forest), F.lit(0.0)) / F.lit(float(max(1, len(forest))))


def scan(docs: DataFrame, forest: list[Node], words: DataFrame, *, least: float = 0.5, **columns) -> DataFrame:
    """Findings of `docs`: doc_id, at, nth, candidate, score, is_secret.

    Null and empty texts, and texts without candidates, give no rows; a null path is no test path; null ids
    stay null. Repeated rows give their findings again. An empty table gives no rows.
    """
    found = featured(candidates(docs, **columns), words).withColumn("score", F.round(score(docs, forest), 6))
    return found.select("doc_id", "at", "nth", "candidate", "score", (F.col("score") >= least).alias("is_secret"))
