"""Secrets in texts: candidate strings by pattern, judged by a random forest.

A candidate is a run of at least `SHORTEST` letters, digits and `+/_-=.` with a letter
and a digit in it, or of letters alone with a credential keyword in one of the three words
before; or the whole value after a credential keyword and a sign, from `VALUE`
characters on, of any kind (quoted values with their spaces); or a line of a private key
block; or the password of an address. Shorter strings without such a place are not seen.
The forest sees its length, its changes between kinds of characters,
how much of it dictionary words cover, what the document's path says, and the words
beside it. It is fitted on labelled findings: a table of your own, or `sample_findings`.
Everything is DataFrame functions and Spark ML; nothing here runs Python on rows.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column
from recurring_metrics.sources.io import materialize

SHORTEST = 16
VALUE = 6
MASK = "[SECRET]"
RUN = rf"[A-Za-z0-9+/_\-=.]{{{SHORTEST},}}"
# A word holds a candidate only if a run of this length has a digit and a letter; judged exactly later.
WORDS = (
    "password secret token example sample test dummy default config class module import return "
    "function string number value user name data file path index page title image style script "
    "version release build commit change update create delete select insert table column "
    "http https www com org net html json xml yaml utf base content type length width height "
    "color font media static public private local remote server client host port request response"
).split()
NAMES = r"api.?key|access.?key|secret|token|passw|passphrase|passcode|(?<![a-z])pass(?![a-z])|(?<![a-z])pin(?![a-z])|pwd|credential|auth|bearer|private.?key|signing"
KEYWORDS = rf"(?i)({NAMES})"
# A credential keyword, what may end its name, a sign, and the value.
KEY_NAME = rf"""(?i:{NAMES})[\w.\-]{{0,40}}["'`]?\]?\s{{0,3}}(?:=>|:=|={{1,3}}|:)\s{{0,3}}(?:(?i:bearer|basic)\s{{1,3}})?"""
ASSIGNED = KEY_NAME + rf"""(?:"[^"\r\n]{{{VALUE},}}"|'[^'\r\n]{{{VALUE},}}'|`[^`\r\n]{{{VALUE},}}`|[^\s"'`]{{{VALUE},}})"""
ADDRESS = rf"""[A-Za-z][A-Za-z0-9+.\-]{{1,20}}://[^\s/:@"'`<>]{{0,80}}:[^\s/@"'`<>]{{{VALUE},}}@"""
KEY_HEAD, KEY_END, KEY_LINE = "BEGIN PRIVATE KEY-----", "-----END", r"^(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2})$"
HARMLESS = r"(?i)(commit|revision|sha\d*|md5|checksum|digest|hash|uuid|guid|etag|integrity|example|sample|dummy|placeholder|https?:|href|src=|version)"
FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "changes", "kind_changes", "distinct", "hex",
    "vowels", "covered", "dots", "slashes", "path_test", "path_code", "path_lock", "keyword_before",
    "assigned", "quoted", "harmless_before", "harmless_after", "plain_after", "uuid_shape",
    "prefixed", "in_key_block", "in_address", "key_value", "measure_key", "other_signs", "one_word", "code_shape",
    "consonants", "mixed", "spaces", "bare_value", "prompt",
)


def _count(of: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(of, F.lit(pattern), F.lit(0))).cast("double")


def _breaks(text: Column) -> Column:
    """White-space runs in a text: how many words its end is behind its start."""
    return F.size(F.split(text, r"\s+")) - 1


def _values(pattern: str, head: str, tail: str) -> Column:
    """(word, last, before_word, holder, candidate) of every match of a pattern in `text`.

    The candidate is the match without what `head` and `tail` match in it. Matches
    neither begin nor end with white space, so the words before add up.
    """
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    between = F.split("text", pattern, -1)

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + _breaks(x["gap"])
        value = F.regexp_replace(F.regexp_replace(x["hit"], head, ""), tail, "")
        last = at + _breaks(x["hit"])
        made = F.struct(
            (last - _breaks(value)).alias("word"), last.alias("last"), at.alias("before_word"),
            x["hit"].alias("holder"), value.alias("candidate"),
        )
        return F.struct(last.alias("at"), F.concat(state["made"], F.array(made)).alias("made"))

    none = F.array().cast("array<struct<word:int,last:int,before_word:int,holder:string,candidate:string>>")
    pairs = F.transform(matches, lambda hit, i: F.struct(F.get(between, i).alias("gap"), hit.alias("hit")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("made")), step)["made"]
    return F.when(F.col("text").rlike(pattern), found).otherwise(none)


def find_candidates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source"
) -> DataFrame:
    """(id, word, last, path, before, after, holder, candidate), one row per candidate in a text.

    `word` and `last` are the positions of the white-space separated words that hold
    its beginning and its end, `before` and `after` are up to three words on either
    side; before a line of a private key they begin with the block's head. A run
    that is part of a whole value is no candidate of its own. Null texts have none.
    """
    text = column(text_col)
    path = column(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(column(id_col).alias("id"), path.alias("path"), text.alias("text"))
    likely = rows.where(
        F.col("text").rlike(RUN) | F.col("text").rlike(ASSIGNED) | F.col("text").rlike(ADDRESS)
    )
    quotes = """["'`]"""
    given = F.concat(
        _values(ASSIGNED, rf"^{KEY_NAME}{quotes}?", rf"{quotes}$|[,;.)\]}}>]+$"),
        _values(ADDRESS, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^:]*:", "@$"),
    )
    words = likely.select("id", "path", F.split("text", r"\s+").alias("words"), given.alias("given"), F.contains("text", F.lit("PRIVATE KEY-----")).alias("keyed"))
    def heads(at: Column) -> Column:
        """A block begins behind `-----BEGIN`, one word or none, `PRIVATE KEY-----`."""
        return F.get("words", at - 2).endswith("-----BEGIN") | F.get("words", at - 3).endswith("-----BEGIN")

    begins = F.filter(
        F.transform(
            "words",
            lambda w, i: F.when(w.contains("KEY-----") & (F.get("words", i - 1) == "PRIVATE") & heads(i), i),
        ),
        lambda i: i.isNotNull(),
    )
    ends = F.filter(F.transform("words", lambda w, i: F.when(w.contains(KEY_END), i)), lambda i: i.isNotNull())
    # Without an end, a block ends with the first word that is no line of a key.
    other = F.filter(F.transform("words", lambda w, i: F.when(~w.rlike(KEY_LINE), i)), lambda i: i.isNotNull())
    spans = F.transform(
        begins,
        lambda b: F.struct(
            b.alias("a"),
            F.coalesce(
                F.array_min(F.filter(ends, lambda e: e > b)), F.array_min(F.filter(other, lambda e: e > b)), F.size("words")
            ).alias("z"),
        ),
    )
    words = words.withColumn("blocks", F.when(F.col("keyed"), spans).otherwise(F.array().cast("array<struct<a:int,z:int>>")))

    def in_block(at: Column) -> Column:
        return F.exists("blocks", lambda k: (k["a"] < at) & (at < k["z"]))

    held = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("word"), w.alias("holder"), in_block(i).alias("block"))),
        lambda s: (F.length(s["holder"]) >= SHORTEST) | s["block"],
    )

    def named(at: Column) -> Column:
        """A credential keyword in one of the three words before."""
        around = F.slice("words", F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3)))
        return F.exists(around, lambda w: w.rlike(KEYWORDS))

    def runs(at: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(at["holder"], F.lit(RUN), F.lit(0)))
        line = F.regexp_extract(at["holder"], r"^[A-Za-z0-9+/=]{4,}$", 0)
        trimmed = F.transform(found, lambda c: F.regexp_replace(c, r"^[A-Za-z_.\-]{1,24}=|^[.\-_/=]+|[.\-_]+$", ""))
        sound = F.filter(
            trimmed,
            lambda c: (F.length(c) >= SHORTEST) & c.rlike("[A-Za-z]") & (c.rlike("[0-9]") | (c.rlike("^[A-Za-z]+$") & named(at["word"]))),
        )
        chosen = F.when(at["block"] & (line != ""), F.array(line)).otherwise(sound)
        return F.transform(
            chosen,
            lambda c: F.struct(
                at["word"].alias("word"), at["word"].alias("last"), at["word"].alias("before_word"),
                at["holder"].alias("holder"), c.alias("candidate"),
            ),
        )

    whole = F.filter("given", lambda g: F.length(g["candidate"]) >= VALUE)
    parted = words.withColumn("whole", whole).withColumn("runs", F.flatten(F.transform(held, runs)))
    apart = F.filter(
        "runs",
        lambda r: ~F.exists("whole", lambda g: r["word"].between(g["word"], g["last"]) & g["candidate"].contains(r["candidate"])),
    )
    placed = parted.select("id", "path", "words", "blocks", F.explode(F.concat("whole", apart)).alias("at"))
    first, last = F.col("at.before_word"), F.col("at.last")
    before = F.array_join(F.slice("words", F.greatest(first - 2, F.lit(1)), F.least(first, F.lit(3))), " ")
    return placed.select(
        "id", F.col("at.word").alias("word"), last.alias("last"), "path",
        F.when(in_block(F.col("at.word")), F.concat(F.lit(f"-----{KEY_HEAD} "), before)).otherwise(before).alias("before"),
        F.array_join(F.slice("words", last + 2, F.lit(3)), " ").alias("after"),
        F.col("at.holder").alias("holder"), F.col("at.candidate").alias("candidate"),
    )


def with_features(found: DataFrame) -> DataFrame:
    """The candidates with one double column per feature and the vector `features`."""
    c, path = F.col("candidate"), F.lower(F.coalesce(F.col("path"), F.lit("")))
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    ahead = F.expr("substring_index(holder, candidate, 1)")
    near = F.concat_ws(" ", before, ahead)
    n = F.length(c).cast("double")
    kinds = r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"
    flag = lambda test: test.cast("double")
    behind = F.expr("substring(holder, length(substring_index(holder, candidate, 1)) + length(candidate) + 1, 1)")
    sign = r"""["'`]?\]?\s*(=>|:=|=|:)\s*((?i:bearer|basic)\s+)?["'`]?$"""
    values = {
        "length": n,
        "digits": _count(c, "[0-9]") / n,
        "uppers": _count(c, "[A-Z]") / n,
        "lowers": _count(c, "[a-z]") / n,
        "signs": _count(c, "[^A-Za-z0-9]") / n,
        "changes": _count(c, r"(.)(?!\1)(?=.)") / n,
        "kind_changes": _count(c, kinds) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "hex": flag(c.rlike("^(0x)?([0-9a-f]+|[0-9A-F]+)$")),
        "vowels": _count(F.lower(c), "[aeiou]") / n,
        "covered": 1.0 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(WORDS, key=len, reverse=True)), "")) / n,
        "dots": _count(c, "[.]"),
        "slashes": _count(c, "/"),
        "path_test": flag(path.rlike("test|spec|fixture|example|mock|docs?/")),
        "path_code": flag(path.rlike(r"\.(py|js|ts|java|go|rb|php|c|cpp|sh|env|ya?ml|ini|toml|conf|properties)$")),
        "path_lock": flag(path.rlike(r"lock|\.(sum|svg|map|min\.js|csv|ipynb)$")),
        "keyword_before": flag(near.rlike(KEYWORDS)),
        "assigned": flag(near.rlike(r"""(=|:|=>)\s*["'`]?$""")),
        "quoted": flag(ahead.rlike("""["'`]$""")),
        "harmless_before": flag(near.rlike(HARMLESS)),
        "harmless_after": flag(after.rlike(HARMLESS)),
        "plain_after": flag(after.rlike(r"^[A-Za-z]+[ ,.]")),
        "uuid_shape": flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "prefixed": flag(c.rlike(r"^(gh[pousr]_|github_pat_|AKIA|ASIA|xox[abprs]-|sk-|sk_live_|rk_live_|glpat-|eyJ[A-Za-z0-9]|AIza|npm_|hf_|SG\.)[A-Za-z0-9_.\-]{12,}$")),
        "in_key_block": flag(near.rlike("BEGIN [A-Z ]*PRIVATE KEY-----")),
        "in_address": flag(ahead.rlike("""://[^/\\s"']*$""") & (behind == "@")),
        "key_value": flag(near.rlike(KEYWORDS + r"[\w.\-]{0,40}" + sign)),
        "measure_key": flag(near.rlike(r"(?i)(count|limit|length|size|max|min|num|expir\w*|ttl|type|name|file|path|url|uri|field|policy|hint|timeout|page|version|tokens|id|at)" + sign)),
        "other_signs": _count(c, r"[^A-Za-z0-9+/_\-=.\s]") / n,
        "one_word": flag(c.rlike(r"^[A-Za-z]?[a-z]+$")),
        "code_shape": flag(c.rlike(r"^[$<{\[(%]|\w[(\[]|[({<]$|^(self|this|os|process|env|request|config|settings|args)\.|^[a-z_]+(\.[a-z_]+)+$|^[A-Z]+(_[A-Z]+)+$|[*x]{5}")),
        "consonants": flag(F.lower(c).rlike("[bcdfghjklmnpqrstvwxz]{5}")),
        "mixed": flag(c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9]")),
        "spaces": _count(c, r"\s"),
        "prompt": flag(c.rlike(r"(?i)\b(enter|your|please|the|must|is|are|not|invalid|required|forgot|reset|missing|new|for|of|password|token)\b")),
        "bare_value": flag(c.rlike("^[0-9]+$")),
    }
    wide = found.select("*", *[values[name].alias(name) for name in FEATURES])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide)


def sample_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled findings (path, before, after, holder, candidate, label) of usual kinds.

    Strings are derived from the row number by hashes: half are credentials in
    the places where they leak (after a keyword and a sign, bare in prose or lists,
    in addresses, in private key blocks), half are what scanners report wrongly (digests,
    identifiers, addresses, file names, placeholders, prompts, code). Bounded by `rows`.
    """
    n, staged = F.col("id"), spark.range(rows)

    def kept(name: str, value: Column) -> Column:
        """A column of its own, so that what builds on it does not repeat it."""
        nonlocal staged
        staged = staged.withColumn(name, value)
        return F.col(name)

    digest = F.sha2(F.concat(F.lit("finding"), n.cast("string")), 512)
    digest = kept("digest", digest)
    coded = F.base64(F.unhex(F.substring(digest, 1, 96)))
    coded = kept("coded", coded)
    plain = F.regexp_replace(coded, "[+/=]", "q")
    plain = kept("plain", plain)
    pick = lambda salt, *items: F.element_at(
        F.array(*[F.lit(x) for x in items]), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(items))) + 1).cast("int")
    )
    word = lambda salt: pick(salt, "data", "page", "image", "release", "content", "user", "static", "module", "title", "table")
    key = pick(1, "token", "api_key", "apikey", "secret", "password", "access_key", "auth_token", "client_secret", "private_key", "bearer")
    filler = pick(2, "and then we", "of the", "is", "en la", "", "der die", "que les")
    sign, quote = pick(3, "=", ":", "=>"), pick(4, '"', "'", "", '"')
    key = kept("key", key)
    filler = kept("filler", filler)
    sign = kept("sign", sign)
    quote = kept("quote", quote)
    uuid = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    size = (F.pmod(F.xxhash64(n, F.lit(9)), F.lit(25)) + 20).cast("int")
    size = kept("size", size)
    secret = F.element_at(
        F.array(
            F.substring(digest, 1, 40), F.substring(digest, 1, 32), F.substring(digest, 1, 64),
            plain.substr(F.lit(1), size), coded.substr(F.lit(1), size),
            F.concat(F.lit("AKIA"), F.upper(plain.substr(1, 16))),
            F.concat(F.lit("ghp_"), plain.substr(1, 36)), F.concat(F.lit("sk-"), plain.substr(1, 40)),
            F.concat(F.lit("xoxb-"), F.conv(F.substring(digest, 1, 10), 16, 10), F.lit("-"), plain.substr(1, 24)),
            F.concat(F.lit("eyJhbGciOi"), plain.substr(1, 20), F.lit("."), plain.substr(21, 30)),
        ),
        (F.pmod(F.xxhash64(n, F.lit(5)), F.lit(10)) + 1).cast("int"),
    )
    secret = kept("secret", secret)
    digits = F.lpad(F.conv(F.substring(digest, 1, 12), 16, 10), 6, "1")
    digits = kept("digits", digits)
    wrong = F.element_at(
        F.array(
            F.struct(pick(6, "commit", "revision", "checksum", "sha1", "etag").alias("before"), F.substring(digest, 1, 40).alias("c")),
            F.struct(pick(6, "sha256", "integrity", "digest", "md5", "hash").alias("before"), F.substring(digest, 1, 64).alias("c")),
            F.struct(pick(6, "uuid", "id", "guid", "of", "the").alias("before"), uuid.alias("c")),
            F.struct(filler.alias("before"), F.concat(F.lit("www."), word(7), F.lit("."), word(8), F.substring(digits, 1, 3), F.lit(".example.com")).alias("c")),
            F.struct(filler.alias("before"), F.concat(word(7), F.lit("/"), word(8), F.lit("/"), word(9), F.substring(digits, 1, 2), F.lit(".html")).alias("c")),
            F.struct(filler.alias("before"), F.concat(word(7), F.lit("_"), word(8), F.lit("_"), word(9), F.lit("_"), F.substring(digits, 1, 2)).alias("c")),
            F.struct(filler.alias("before"), F.concat(word(7), F.lit("-"), word(8), F.lit("-20"), F.substring(digits, 1, 2), F.lit("-10-11")).alias("c")),
            F.struct(F.concat(key, F.lit(" "), sign).alias("before"), F.concat(F.lit("your-"), word(7), F.lit("-"), key, F.lit("-here1")).alias("c")),
            F.struct(F.concat(key, F.lit(" "), sign).alias("before"), F.concat(F.lit("example_"), key, F.lit("_1234567890")).alias("c")),
            F.struct(filler.alias("before"), F.concat(word(7), F.substring(digits, 1, 2), F.lit("."), word(8), F.lit("@mail"), F.lit(".example.com")).alias("c")),
            F.struct(filler.alias("before"), F.concat(F.repeat(F.lit("1a"), 10), F.substring(digits, 1, 2)).alias("c")),
        ),
        (F.pmod(F.xxhash64(n, F.lit(10)), F.lit(11)) + 1).cast("int"),
    )
    wrong = kept("wrong", wrong)
    noun = lambda salt: pick(salt, "hunter", "dragon", "winter", "orange", "correct", "horse", "battery", "staple", "monkey", "summer", "silver", "river")
    mark = lambda salt: pick(salt, "!", "@", "#", "$", "%", "&", "*", "?", "^", "~")
    prefixed = F.element_at(
        F.array(
            F.concat(F.lit("AKIA"), F.upper(plain.substr(1, 16))), F.concat(F.lit("ghp_"), plain.substr(1, 36)),
            F.concat(F.lit("sk-"), plain.substr(1, 40)), F.concat(F.lit("glpat-"), plain.substr(1, 20)),
            F.concat(F.lit("xoxb-"), F.conv(F.substring(digest, 1, 10), 16, 10), F.lit("-"), plain.substr(1, 24)),
            F.concat(F.lit("eyJhbGciOi"), plain.substr(1, 20), F.lit("."), F.lit("eyJ"), plain.substr(21, 30), F.lit("."), plain.substr(5, 30)),
        ),
        (F.pmod(F.xxhash64(n, F.lit(21)), F.lit(6)) + 1).cast("int"),
    )
    prefixed = kept("prefixed", prefixed)
    short = (F.pmod(F.xxhash64(n, F.lit(22)), F.lit(7)) + 6).cast("int")
    letters = F.regexp_replace(plain, "[0-9]", "k")
    letters = kept("letters", letters)
    chosen = F.element_at(
        F.array(
            F.concat(noun(23), F.substring(digits, 1, 1), F.upper(letters.substr(1, 1)), F.substring(digits, 2, 1)),
            F.concat(F.initcap(noun(23)), mark(24), F.substring(digits, 1, 3), mark(25)),
            F.concat(plain.substr(1, 4), mark(24), plain.substr(5, 4), mark(25), plain.substr(9, 4)),
            plain.substr(F.lit(1), short), letters.substr(F.lit(1), short + 3), F.lower(letters.substr(F.lit(1), short + 4)),
            F.concat(noun(23), noun(26)), F.substring(digits, 1, 8), F.concat(noun(23), F.lit("-"), noun(26), F.substring(digits, 1, 2)),
        ),
        (F.pmod(F.xxhash64(n, F.lit(27)), F.lit(9)) + 1).cast("int"),
    )
    chosen = kept("chosen", chosen)
    phrase = F.concat_ws(" ", noun(23), noun(26), noun(28), noun(29))
    line, earlier = coded.substr(1, 64), F.base64(F.unhex(F.sha2(digest, 384)))
    phrase = kept("phrase", phrase)
    line = kept("line", line)
    earlier = kept("earlier", earlier)
    host = pick(30, "github.com/a/b", "db.internal:5432/main", "example.org/x", "10.0.0.7/path")
    scheme = pick(31, "https", "postgres", "redis", "amqp")
    row = lambda before, holder, c: F.struct(before.alias("before"), holder.alias("holder"), c.alias("c"))
    joined = F.pmod(F.xxhash64(n, F.lit(11)), F.lit(3)) == 0
    spoken = F.concat_ws(" ", filler, key, sign)

    def given(c: Column) -> Column:
        """A value after a keyword and a sign, as `find_candidates` gives it."""
        gap = pick(32, "", " ")
        return row(filler, F.concat(key, gap, sign, gap, quote, c, quote), c)

    spelled = F.concat(F.lower(letters.substr(1, 9)), F.upper(letters.substr(10, 6)), letters.substr(16, 14))
    said_key = pick(51, "the token is", "api key is", "password was", "secret:", "use token", "with the bearer token")
    lettered = row(said_key, F.concat(spelled.substr(F.lit(1), size), pick(52, "", ".", ",")), spelled.substr(F.lit(1), size))
    listed = row(pick(33, "use", "it was", "key is", "-", "then export", "of the", "log in with", ""), F.concat(pick(34, "", "", "(", "`"), prefixed, pick(35, "", ",", ".", "")), prefixed)
    keyed = row(spoken, F.when(joined, F.concat(key, sign, quote, secret, quote)).otherwise(F.concat(quote, secret, quote)), secret)
    leaks = F.array(
        keyed, keyed, given(secret), listed, listed,
        row(filler, F.concat(scheme, F.lit("://"), prefixed, F.lit("@"), host), prefixed),
        row(filler, F.concat(scheme, F.lit("://"), noun(23), F.lit(":"), chosen, F.lit("@"), host), chosen),
        row(F.concat(F.lit(f"-----{KEY_HEAD} "), F.when(joined, F.lit("PRIVATE KEY-----")).otherwise(earlier)), F.when(n % 3 == 0, coded.substr(F.lit(1), size)).otherwise(line), F.when(n % 3 == 0, coded.substr(F.lit(1), size)).otherwise(line)),
        given(chosen), given(chosen), given(chosen),
        row(filler, F.concat(key, sign, F.lit('"'), phrase, F.lit('"')), phrase), lettered,
    )
    plainly = row(F.concat_ws(" ", filler, wrong["before"]), wrong["c"], wrong["c"])
    said = pick(
        40, "required", "string", "missing", "optional", "invalid", "disabled", "default", "nothing", "important", "between",
        "everyone", "getpass.getpass()", "os.environ['TOKEN']", "request.headers.get('x')", "self.password", "${DB_PASSWORD}",
        "<password>", "{{ vault_pass }}", "process.env.SECRET", "config.secret", "get_token(user)", "settings.API_KEY", "********", "xxxxxxxx",
        "Enter your password", "Please enter the token", "must not be empty", "Bearer", "secretRef", "params[:token]",
    )
    said = kept("said", said)
    prose = pick(54, "server", "first", "restart", "every", "worker", "there", "Install", "afterwards", "here", "base64", "document", "configuration", "replace", "placeholder", "yourkeygoeshere", "Donaudampfschifffahrt")
    longer = F.element_at(
        F.array(
            pick(55, "internationalization", "authenticationServer", "Verantwortlichkeiten", "incomprehensibilities", "acknowledgementsPage"),
            F.concat(word(7), F.initcap(word(8)), F.initcap(word(9)), F.lit("Handler")), F.concat(word(7), F.lit("under"), word(8), F.lit("heit"), word(9), F.lit("ment")),
        ),
        (F.pmod(F.xxhash64(n, F.lit(56)), F.lit(3)) + 1).cast("int"),
    )
    longer = kept("longer", longer)
    prose = kept("prose", prose)
    measured = pick(41, "token_count", "max_tokens", "password_length", "token_url", "auth_type", "secret_name", "token_expiry", "key_file", "auth_version")
    measure = pick(42, "128000", "100000", "https://example.com/oauth/token", "oauth2-client", "production/db-secret", "3600000", "/etc/app/key.pem", "2024-01-01")
    camel = F.concat(F.initcap(word(7)), F.initcap(word(8)), F.substring(digits, 1, 2), F.initcap(word(9)))
    camel = kept("camel", camel)
    loose = coded.substr(F.lit(1), size)
    harmless = F.array(
        plainly, plainly, plainly, plainly,
        row(filler, F.concat(camel, pick(43, "", ",", "()", ".")), camel),
        row(filler, F.concat(F.lit("data:image/png;base64,"), line), line),
        row(filler, loose, loose),
        row(pick(44, "BEGIN CERTIFICATE-----", "ssh-rsa", "integrity", ""), line, line),
        row(earlier, line, line),
        row(filler, F.concat(F.lit("https://youtu.be/watch?v="), plain.substr(1, 18)), plain.substr(1, 18)),
        row(filler, F.concat(key, pick(45, "", " "), sign, pick(46, "", " "), said), said),
        row(filler, F.concat(key, sign, F.lit(" "), quote, said, quote), said),
        row(filler, F.concat(measured, pick(45, "", " "), pick(47, "=", ":"), F.lit(" "), measure), measure),
        row(F.concat(F.lit(f"-----{KEY_HEAD} "), pick(53, "Install the", "and then", "your key", "lines of base64")), prose, prose),
        row(said_key, F.concat(longer, pick(52, "", ".", ",")), longer),
        row(F.concat_ws(" ", F.lit("END PRIVATE KEY-----"), filler), prose, prose),
    )
    measured = kept("measured", measured)
    measure = kept("measure", measure)
    real = n % 2 == 0
    any_of = lambda salt, items, count: F.element_at(items, (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(count)) + 1).cast("int"))
    # In parts: Spark cannot compile all kinds of findings in one piece.
    staged = materialize(staged)
    staged = materialize(
        staged.where(real).withColumn("made", any_of(48, leaks, 13))
        .unionByName(staged.where(~real).withColumn("made", any_of(49, harmless, 16)))
    )
    made = F.col("made")
    before, holder, candidate = made["before"], made["holder"], made["c"]
    return materialize(
        staged.select(
            pick(12, "src0", "web", "src/app.py", "config/settings.yaml", ".env", "docs/guide.md", "test/data.json", "package-lock.json").alias("path"),
            before.alias("before"),
            pick(13, "and the", "of it", "", "en de", "; next line").alias("after"),
            holder.alias("holder"),
            candidate.alias("candidate"),
            F.when(real, 1.0).otherwise(0.0).alias("label"),
        )
        .where(F.length("candidate") >= VALUE)
    )


def fit(findings: DataFrame, trees: int = 30, depth: int = 8) -> Model:
    """A random forest from labelled findings; `label` is 1 for a secret, else 0."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird")
    return forest.fit(with_features(findings).select("features", "label"))


def judged(found: DataFrame, model: Model, least: float) -> DataFrame:
    """The candidates that the forest takes for secrets, with their chance."""
    seen = model.transform(with_features(found)).withColumn("chance", vector_to_array("probability")[1])
    return seen.where(F.col("chance") >= least)


def scan(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    least: float = 0.5,
) -> DataFrame:
    """The candidates that the forest takes for secrets: id, word, secret, chance.

    One row per place of a secret; repeated rows give repeated findings. Null,
    empty and harmless texts give none, nor does an empty table. A null path or
    a table without one counts as a path that says nothing.
    """
    found = judged(find_candidates(docs, id_col, text_col, path_col), model, least)
    return found.select(F.col("id").alias(id_col), "word", F.col("candidate").alias("secret"), "chance")


def mask(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    least: float = 0.5,
) -> DataFrame:
    """`docs` with every secret replaced by a mask where it stands; columns and row count stay.

    The same string elsewhere, alone or inside other words, stays. Rows of equal id,
    path and text share their findings; rows with a null id are masked too.
    """
    path = column(path_col).cast("string") if path_col in docs.columns else F.lit("")
    key = F.sha2(F.concat_ws("\x1f", column(id_col).cast("string"), path, column(text_col)), 256)
    keyed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), key.alias("row_key"))
    texts = keyed.select(
        "row_key", F.col("row").getField(text_col).alias("text"),
        (F.col("row").getField(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")).alias("path"),
    )
    found = judged(find_candidates(texts, "row_key", "text", "path"), model, least)
    # Places that share a word are one stretch.
    by_place = Window.partitionBy("id").orderBy("word", "last")
    until = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("word") <= until, 0).otherwise(1)
    stretches = (
        found.select("id", "word", "last", "candidate").distinct()
        .withColumn("begins", begins)
        .withColumn("stretch", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("id", "stretch")
        .agg(
            F.min("word").alias("word"), F.max("last").alias("last"),
            # Longer secrets first: one may hold another.
            F.sort_array(F.collect_set(F.struct((-F.length("candidate")).alias("n"), F.col("candidate").alias("secret")))).alias("secrets"),
        )
    )
    per_text = stretches.groupBy(F.col("id").alias("found_key")).agg(
        F.sort_array(F.collect_list(F.struct("word", "last", "secrets"))).alias("places")
    )
    joined = keyed.join(per_text, F.col("row_key") == F.col("found_key"), "left")
    text = F.col("row")[text_col]

    def masked(state: Column) -> Column:
        """The words with the white space behind them, stretch by stretch, and what follows the last one."""
        words, places = state["tokens"], state["places"]

        def upto(at: Column, k: Column) -> Column:
            first = F.coalesce(F.get(places, k - 1)["last"], F.lit(-1)) + 1
            clean = F.array_join(F.slice(words, first + 1, at["word"] - first), "")
            held = F.array_join(F.slice(words, at["word"] + 1, at["last"] - at["word"] + 1), "")
            return F.concat(clean, F.aggregate(at["secrets"], held, lambda t, x: F.replace(t, x["secret"], F.lit(MASK))))

        tail = F.element_at(places, -1)["last"] + 1
        rest = F.array_join(F.slice(words, tail + 1, F.greatest(F.size(words) - tail, F.lit(0))), "")
        return F.concat(F.array_join(F.transform(places, upto), ""), rest)

    tokens = F.zip_with(
        F.split(text, r"\s+", -1), F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0)), lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))
    )
    # Bound by a transform of one element, so that the words are made once.
    whole = F.transform(F.array(F.struct(tokens.alias("tokens"), F.col("places").alias("places"))), masked)[0]
    clean = F.when(F.col("places").isNull(), text).otherwise(whole)
    return joined.select(*[(clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
