"""Secret scan: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame functions. A candidate is a known key format wherever it stands, a value of
4 characters and more (any but blanks, or quoted) behind an assignment word, or a run of 20 and
more key characters, which `=` ends except as padding; the parts of a run between slashes are
candidates too. What stands before and behind comes from splitting the text at candidates. The
features are the candidate's length, its transitions between character classes, how much of it a
dictionary and common letter pairs cover, whether it stands in a path, and the words beside it.
The forest is trained from labelled findings; `example_findings` makes a set from rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

# Formats of keys, with the name of the rule
FORMATS = {
    "aws_key_id": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "stripe_key": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
_KEY_CHARS, _LEAST = r"A-Za-z0-9+/_\-", 20
_FORMAT = f"(?<![A-Za-z0-9])(?:{'|'.join(FORMATS.values())})(?![A-Za-z0-9])"
_RUN = f"(?<![{_KEY_CHARS}])(?=[{_KEY_CHARS}]{{{_LEAST}}})(?:(?!{_FORMAT})[{_KEY_CHARS}]){{{_LEAST},}}+(?:={{1,2}}(?![{_KEY_CHARS}=\"'`$]))?"
# a name with an assignment word, and what assigns; of bounded length, as it is looked for backwards
_LEAD = r"""(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth(?:orization)?|credentials?)[A-Za-z0-9_\-]{0,16}["'\]]{0,2}\s{0,3}(?:[:=]{1,2}>?|\bis\b)\s{0,3}(?:(?i:bearer|basic)\s{1,2})?"""
_LEADS = "(?i:token|secret|passw|passphrase|pwd|key|auth|credential)"  # every _LEAD has one
_QUOTED = "|".join(rf"(?<={q})(?<={_LEAD}{q})(?:(?!{_FORMAT})(?:[^{q}\\\r\n]|\\.)){{4,}}+(?={q})" for q in "\"'`")
_BARE = rf"""(?<=[\s:=>"'`])(?<={_LEAD}["'`]?)(?!(?i:bearer|basic)\s)(?:(?!&\w{{1,32}}=|{_FORMAT}|[.,;:)\]}}]{{1,8}}+(?:[\s"'`]|\z))[^\s"'`]){{4,}}+"""
CANDIDATE = f"{_FORMAT}|{_RUN}"
ASSIGNED_TOO = f"{_FORMAT}|{_QUOTED}|{_BARE}|{_RUN}"
_ASSIGNED = r"""(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth(?:orization)?|bearer|credentials?)["'\]]*\s*(?:[:=]+>?|is|bearer)?\s*["'`]?$"""
_NAMED = r"(?i)(?:token|secret|passw|pwd|key|auth|bearer|credential)"
_HASH_WORDS = r"(?i)(?:sha-?\d*|md5|crc|commit|checksum|digest|etag|revision|rev|hash|uuid|guid|integrity|build|blob|tree|image)\W{0,4}(?:id)?\W{0,4}$"
_SAMPLE_WORDS = r"(?i)(?:example|sample|dummy|placeholder|changeme|change_me|your|xxxx|\*\*\*|fake|redacted|insert|todo|1234567|abcdef)"
_PATH_BEFORE, _PATH_AFTER = r"(?:[/\\.]|://\S*|www\.\S*|[?&]\w+=)$", r"^(?:[/\\]|\.[a-z]{2,4}\b)"
_DICTIONARY = "the|and|ing|tion|ment|able|ness|over|under|with|from|that|this|have|name|user|test|data|file|path|list|item|type|value|class|default|config|manager|service|request|response|controller|handler|factory|string|number|example|sample|secret|token|password|public|private|static|return|function|import|http|www|image|page|index|content|version|update|delete|create|select|order|lich|keit|ung|schaft|eaux|elle|que|ción|ado|mente"
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|ou|le|ch|de|qu|ie|ei|ne|ic|la|ra|ri|io|ll"


def _beside(candidate: Column, before: Column, behind: Column) -> Column:
    return F.struct(candidate.alias("candidate"), F.right(before, F.lit(48)).alias("before"), F.left(behind, F.lit(48)).alias("behind"))


def _with_parts(around: Column) -> Column:
    """Of each candidate of an array: it, and what of it stands between slashes and is long enough to be one.

    A part's surroundings are built from the 48 pieces beside it, each cut to 48 characters, and all
    that a run's parts share is made once, so that the work is in proportion to the run's length.
    """
    near = 48
    cut = F.transform(around, lambda x: F.struct(x.alias("x"), F.split(x["candidate"], "/").alias("cut")))
    ready = F.transform(cut, lambda y: F.struct(
        y["x"].alias("x"), y["cut"].alias("cut"), F.transform(y["cut"], lambda c: F.right(c, F.lit(near))).alias("ends"), F.transform(y["cut"], lambda c: F.left(c, F.lit(near))).alias("starts"),
        F.filter(F.sequence(F.lit(0), F.size(y["cut"]) - 1), lambda i: F.length(F.get(y["cut"], i)) >= _LEAST).alias("at"),
    ))

    def part(y: Column, i: Column) -> Column:
        first = F.greatest(i - near, F.lit(0))
        before = F.concat_ws("/", F.slice(y["ends"], first + 1, i - first), F.lit(""))
        behind = F.concat_ws("/", F.lit(""), F.slice(y["starts"], i + 2, F.lit(near)))
        one = F.when(i > 0, before).otherwise(F.lit(""))
        two = F.when(i + 1 < F.size(y["cut"]), behind).otherwise(F.lit(""))
        return _beside(F.get(y["cut"], i), F.concat(y["x"]["before"], one), F.concat(two, y["x"]["behind"]))

    parts = lambda y: F.when(F.size(y["cut"]) > 1, F.transform(y["at"], lambda i: part(y, i)))
    none = lambda y: F.filter(F.array(y["x"]), lambda _: F.lit(False))
    return F.transform(ready, lambda y: F.concat(F.array(y["x"]), F.coalesce(parts(y), none(y))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, nth, candidate, before, behind) for each candidate of each row's whole text; a run's parts follow it."""
    t = docs.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    named = F.col("_t").rlike(_LEADS)
    by = lambda f: F.when(named, f(ASSIGNED_TOO)).otherwise(f(CANDIDATE))  # noqa: E731  most texts need the plain pattern only
    t = t.withColumn("_hits", by(lambda p: F.regexp_extract_all("_t", F.lit(p), F.lit(0)))).where(F.size("_hits") > 0)
    t = t.withColumn("_parts", by(lambda p: F.split("_t", p, -1)))
    hit = lambda i: F.coalesce(F.get("_hits", i), F.lit(""))
    around = F.transform("_hits", lambda h, i: _beside(h, F.concat(hit(i - 1), F.get("_parts", i)), F.concat(F.get("_parts", i + 1), hit(i + 1))))
    return t.select(id_col, F.posexplode(F.flatten(_with_parts(around))).alias("nth", "x")).select(id_col, "nth", "x.*")


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """found with numeric feature columns, and their names."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda chars: F.regexp_count(c, F.lit(f"[{chars}]")) / n
    step = lambda a, b: F.regexp_count(c, F.lit(f"[{a}](?=[{b}])")) / n
    covered = lambda words: 1 - F.length(F.regexp_replace(F.lower(c), words, "")) / n
    flag = lambda x: x.cast("double")
    chars = F.split(c, "")
    counts = F.transform(F.array_distinct(chars), lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n)
    cols: dict[str, Column] = {
        "f_length": n.cast("double"), "f_distinct": F.size(F.array_distinct(chars)) / n,
        "f_entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
        "f_digit": share("0-9"), "f_upper": share("A-Z"), "f_lower": share("a-z"), "f_hex": share("0-9a-fA-F"), "f_other": share("+/_=\\-"),
        "f_symbol": share("^A-Za-z0-9+/_=\\-\\s"), "f_blank": share("\\s"), "t_letter_digit": step("A-Za-z", "0-9"), "t_digit_letter": step("0-9", "A-Za-z"), "t_lower_upper": step("a-z", "A-Z"), "t_upper_lower": step("A-Z", "a-z"), "t_same": F.regexp_count(c, F.lit(r"(.)(?=\1)")) / n,
        "d_words": covered(_DICTIONARY), "d_pairs": covered(_PAIRS), "d_sample": flag(F.concat_ws(" ", c, F.col("before")).rlike(_SAMPLE_WORDS)),
        "p_slashes": share("/"), "p_before": flag(F.col("before").rlike(_PATH_BEFORE)), "p_behind": flag(F.col("behind").rlike(_PATH_AFTER)), "p_uuid": flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        "w_assigned": flag(F.col("before").rlike(_ASSIGNED)), "w_named": flag(F.col("before").rlike(_NAMED)), "w_hash": flag(F.col("before").rlike(_HASH_WORDS)), "w_quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("behind").rlike("^[\"'`]")),
        "k_format": flag(c.rlike(f"^(?:{'|'.join(FORMATS.values())})$")),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in cols.items()}), list(cols)


def example_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(candidate, before, behind, secret 0/1): labelled findings made from rules, the same every time."""
    part = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    draw = lambda salt, *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(x))) + 1).cast("int"))
    hexa, mixed = F.concat(part("a"), part("b")), F.regexp_replace(F.concat(F.base64(F.unhex(part("c"))), F.base64(F.unhex(part("d")))), "=", "")
    size = lambda salt, *x: draw(salt, *x)
    name = draw("name", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "TOKEN", "SECRET_KEY", "Api-Key", "bearer")
    assigned = F.concat(draw("lead", "the ", "set ", "", "export ", "ende. ", "la "), name, draw("sep", " = \"", "=", ": ", " = '", ":\"", " = \""))
    close = draw("close", "\" and", "", "\"", "' then", "\"!!", "\"###", "\" der")
    hashes = F.concat(draw("hl", "see ", "", "at "), draw("h", "commit ", "sha1: ", "sha256:", "md5 ", "checksum ", "digest: ", "revision ", "etag: \"", "uuid ", "blob ", "build "))
    words = draw("w", "the", "thin", "oner", "tion", "ment", "keit", "elle", "manager", "service", "request", "erthe", "ununge")
    word = F.concat(words, draw("w2", "ation", "ering", "lich", "eaux", "Controller", "Factory", "anderen", "ingth"), draw("w3", "sten", "onre", "Handler", "mente", "ereren", "List", "heitung"), draw("w4", "anther", "Impl", "tionen", "ción", "ement"))
    path = F.concat(F.lit("usr/"), words, F.lit("/lib/"), words, F.lit("/"), word)
    sample = draw("s", "xxxxxxxxxxxxxxxxxxxxxxxx", "your_api_key_goes_here", "EXAMPLEEXAMPLEEXAMPLE", "abcdefghijklmnopqrstuvwxyz", "12345678901234567890", "changeme-changeme-changeme", "placeholder_secret_value", "00000000000000000000000000000000", "--------------------------", "++++++++++++++++++++", "____________________")
    uuid = F.concat_ws("-", *(F.substring(part("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    short = F.concat(draw("p1", "hunter", "Summer", "dragon", "letme", "s3cr", "Pa", "adm1n", "pass"), draw("p2", "!", "@", "#", "$", "_", "-", "", "."), F.substring(hexa, F.lit(1), size("n6", 1, 2, 3, 4, 6)), draw("p3", "!", "", "?", "%", "*", "Z", "9"))
    plain = draw("v", "required", "string", "null", "None", "true", "false", "undefined", "${PASSWORD}", "<password>", "your_password", "********", "getenv(", "os.environ", "input()", "changeme", "this.value", "config.password", "optional", "missing", "expired")
    kinds = [  # (candidate, before, secret)
        (F.substring(hexa, F.lit(1), size("n1", 40, 32, 40, 64, 48)), assigned, 1), (F.substring(F.upper(hexa), F.lit(1), size("n2", 40, 32, 40)), F.upper(assigned), 1),
        (F.substring(mixed, F.lit(1), size("n3", 24, 32, 40, 44, 64)), assigned, 1), (F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(mixed, "[+/]", "")), 1, 16)), draw("b1", "id ", "key: ", "", "\""), 1),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(mixed, "[+/]", ""), 1, 36)), draw("b2", "use ", "token ", ""), 1), (F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(mixed, "[+/]", ""), 1, 24)), draw("b3", "pay ", "", "\""), 1),
        (F.substring(hexa, F.lit(1), size("n4", 40, 32, 64, 40)), hashes, 0), (F.substring(mixed, F.lit(1), size("n5", 24, 44, 64)), F.concat(draw("b4", "integrity sha", "etag: ", "image ", "blob "), F.lit("256-")), 0),
        (short, assigned, 1), (F.substring(mixed, F.lit(1), size("n7", 8, 10, 12, 16)), assigned, 1), (plain, assigned, 0), (F.concat(words, draw("w5", "", " the ", " ", "s ", "er"), draw("w6", "", "word", "is here", "list")), assigned, 0),
        (word, draw("b5", "and ", "", "the ", "der ", "les "), 0), (path, draw("b6", "/", "see /", "./", "https://"), 0), (sample, draw("b7", "token = \"", "api_key=", "", "password: "), 0), (uuid, draw("b8", "uuid ", "id: ", "guid=", ""), 0),
    ]
    pick = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda i: F.coalesce(*(F.when(pick == k, x[i]) for k, x in enumerate(kinds)))
    return spark.range(0, rows, 1, 1).select("id", choose(0).alias("candidate"), choose(1).alias("before"), close.alias("behind"), F.coalesce(*(F.when(pick == k, F.lit(x[2])) for k, x in enumerate(kinds))).alias("secret")).where("length(candidate) > 0")


def train(labelled: DataFrame, trees: int = 24, depth: int = 7, most_rows: int = 200_000, seed: int = 11):
    """A forest over `features` from (candidate, before, behind, secret); at most `most_rows` of them, chosen by hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n = labelled.count()
    if n > most_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("candidate", "before"), F.lit(1 << 20)) < F.lit((1 << 20) * most_rows // n))
    rows, names = features(labelled)
    rows = VectorAssembler(inputCols=names, outputCol="_x").transform(rows).select("_x", F.col("secret").cast("double").alias("_y"))
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(docs: DataFrame, forest=None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, nth, rule, candidate, score, is_secret): one row for each candidate of each row, `nth` from 0 in the text.

    Null and empty texts have no candidates; null ids are kept, repeated rows give repeated
    findings; other columns are ignored. rule is the key format's name, or `generic`.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    forest = forest or train(example_findings(docs.sparkSession))
    rows, names = features(candidates(docs, id_col, text_col).withColumnRenamed(id_col, "_id"))
    rows = forest.transform(VectorAssembler(inputCols=names, outputCol="_x").transform(rows))
    rule = F.coalesce(*(F.when(F.col("candidate").rlike(f"^(?:{p})$"), F.lit(k)) for k, p in FORMATS.items()), F.lit("generic"))
    score = F.round(vector_to_array("probability")[1], 6)
    return rows.select(F.col("_id").alias(id_col), "nth", rule.alias("rule"), "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def secret_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct ids of rows with a secret."""
    return scan(docs, id_col=id_col, text_col=text_col).where("is_secret").select(id_col).distinct()


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "nth", "rule", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
