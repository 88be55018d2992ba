"""Secret scans in DataFrame operations only, with a random forest that removes false positives.

Candidates are private keys in their frames, signed JSON tokens, values assigned to a name with a secret word, of any length
and characters, passwords in URLs, and elsewhere runs of at least SHORTEST key characters that hold a digit. Their features
(length, character transitions, dictionary coverage, path and neighbouring words) are SQL expressions. The forest is trained
on the driver from texts with labelled findings that a seeded generator writes; its candidates are cut and its features made
by the expressions that scan documents. It is compiled into one SQL expression.
"""

from __future__ import annotations

import functools
import random
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxloom.llm.common import column, unused

SHORTEST = 16
MASK = "[SECRET]"
THRESHOLD = 0.5
SECRET_WORDS = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credentials?|auth|bearer|client[_-]?secret"
PLAIN_WORDS = "sha1|sha256|sha|md5|commit|checksum|digest|revision|etag|uuid|guid|hash|version|isbn|order|invoice|phone|card|account|id|example|placeholder|dummy|sample"
DICTIONARY = "example|sample|dummy|test|placeholder|changeme|your|here|this|that|with|from|value|none|null|nil|undefined|true|false|required|optional|string|redacted|hidden|forgot|reset|valid|user|name|file|page|home|data|image|version|release|index|config|default|article|product|category|january|february|april|august|september|october|november|december"
#: A name with a secret word up to the value that it is assigned, its opening quote included; and a URL up to its password.
ASSIGNED = rf"(?:(?i:{SECRET_WORDS})(?:[_-]?[0-9]{{1,4}}|[_-][A-Za-z0-9_-]{{1,16}})?\\?[\"'\]]?(?:\s{{0,4}}[:=]{{1,2}}>?|\s{{1,3}}is(?=\s))\s{{0,3}}|(?i:bearer)\s{{1,3}})\\?[\"'(]?"
IN_URL = r"://[^\s/?#@:\"'<>]{0,64}:"
#: A quoted value ends at its quote; another at white space, a quote, an angle or the next name, without a stop at its end.
_VALUE = r"(?:(?<=\")[^\"\n]+(?=\")|(?<=')[^'\n]+(?=')|(?:(?![&;,][A-Za-z_][A-Za-z0-9_.-]{0,30}=)[^\s\"'<>`])+(?<![.,;)\]}\\]))"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
_BEGIN = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: A private key with its frame (to the text's end or the next frame, if it is never closed), and a signed JSON token.
_FRAMED = rf"{_BEGIN}(?:(?!-----)[\s\S])+(?:-----END [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----)?"
_SIGNED = r"(?<![A-Za-z0-9+/_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*)?"
#: A private key, a signed token, an assigned value, a password in a URL, or a run of at least SHORTEST key characters with
#: a digit, not within a longer run; '=' only as padding at a run's end.
CANDIDATE = rf"(?:{_FRAMED}|{_SIGNED}|(?<=[:=>\s\"'(])(?<={ASSIGNED})(?:(?<=[\"'(])|(?![:=>])){_VALUE}|(?<=:)(?<={IN_URL})[^\s/?#\"'<>]+(?=@)|{_RUN})"
#: Texts without a match of this have no candidates; it is cheaper to look for.
HINT = rf"(?:{ASSIGNED}|{IN_URL}[^\s/?#\"'<>]+@|{_RUN}|{_SIGNED}|{_BEGIN})"
#: How far neighbouring words may lie, in characters.
NEAR = 48


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def features(c: str, before: str, after: str, path: str) -> list[str]:
    """SQL of the features of a candidate, given SQL of it, of the text on either side and of the path."""
    low, left = f"lower({c})", f"lower(right({before}, {NEAR}))"
    n = f"char_length({c})"
    return [
        f"cast({n} AS double)",
        f"cast(size(regexp_extract_all({c}, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+', 0)) AS double) / {n}",
        f"cast({n} - char_length(regexp_replace({c}, '[0-9]', '')) AS double) / {n}",
        f"cast(size(array_distinct(split({low}, ''))) AS double) / least({n}, 36)",
        f"1 - cast(char_length(regexp_replace({low}, '{DICTIONARY}', '')) AS double) / {n}",
        f"cast({low} rlike '^[0-9a-f]+$' AS double)",
        f"cast({c} rlike '^[0-9]+$' AS double)",
        f"cast({c} rlike '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-' AS double)",
        f"cast({c} rlike '^(AKIA|ASIA|ghp_|gho_|sk_live|sk-|xox[abp]-|glpat-|AIza|eyJ|-----BEGIN )' AS double)",
        f"cast({left} rlike '({SECRET_WORDS})([_-]?[0-9]{{1,4}}|[_-][a-z0-9_-]{{1,16}})?[\"\\']?\\\\s*([:=]|is|:=|=>)\\\\s*[\"\\'(]?$' AS double)",
        f"cast({left} rlike '({SECRET_WORDS})' AS double)",
        f"cast({left} rlike '(^|[^a-z])({PLAIN_WORDS})[^a-z]{{1,4}}$' AS double)",
        f"cast({left} rlike '[:=]\\\\s*[\"\\']?$' AS double)",
        f"cast(left({after}, 1) IN ('\"', '\\'') AS double)",
        f"cast(right({before}, {NEAR * 2}) rlike {_quoted(IN_URL + '$')} AS double)",
        f"cast({c} rlike '[a-z]' AS double) + cast({c} rlike '[A-Z]' AS double) + cast({c} rlike '[0-9]' AS double) + cast({c} rlike '[^A-Za-z0-9]' AS double)",
        f"cast({c} rlike '^[A-Z]?[a-z]+$' AS double)",
        f"cast({c} rlike '^[$][{{(]|^[{{][{{]|^[$][A-Z_]+$|^[*]+$|[A-Za-z_][(\\\\[]' AS double)",
        f"cast({left} rlike '\\\\s(is|bearer)\\\\s+[\"\\']?$' AS double)",
        f"cast(left({after}, 16) rlike '^[\"\\']?\\\\s*[:=]' AS double)",
        f"cast(lower({path}) rlike 'test|example|sample|mock|fixture|doc' AS double)",
    ]


N_FEATURES = 21


def labelled_findings(n: int = 1800, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, is a secret): findings in the forms that reviewers meet, half of them false."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    word = lambda: pick("aeioutnrslhd", rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    names = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "client_secret", "credential", "private_key", "TOKEN", "API_KEY", "SECRET", "access_key_id", "AWS_ACCESS_KEY_ID", "token_2"]
    plain = ["sha1", "commit", "md5", "checksum", "revision", "etag", "uuid", "hash", "id", "order", "phone", "version", "digest", "card"]
    paths = ["src", "web", "crawl", "main/app", "srv", "src7", "config", "tests/unit", "docs/guide", "examples"]
    rows = []
    for k in range(n):
        quote = rng.choice(['"', "'", ""])
        joint = rng.choice([" = ", "=", ": ", " := ", " => "])
        if k % 12 == 5:
            form = rng.randrange(4)
            if form == 0:
                kind, line = rng.choice(["", "RSA ", "EC ", "OPENSSH "]), rng.choice(["\n", "\\n", "\r\n"])
                value = f"-----BEGIN {kind}PRIVATE KEY-----" + line + line.join(pick(b64, 64) for _ in range(rng.randint(1, 12))) + line + f"-----END {kind}PRIVATE KEY-----"
                before = prose() + rng.choice(["\n", " ", f' {rng.choice(names)}{joint}"'])
                rows.append((value, before, rng.choice(["\n", '"\n']) + prose(), rng.choice(paths), 1))
            elif form == 1:
                value = "eyJ" + ".".join(pick(alnum + "_-", rng.randint(12, 90)) for _ in range(3))
                before = f"{prose()} {rng.choice(['', rng.choice(names) + joint + quote, 'Authorization: Bearer ', '?access_token='])}"
                rows.append((value, before, rng.choice([" ", "\n", quote + " "]) + prose(), rng.choice(paths), 1))
            elif form == 2:  # what is public
                value = pick(b64, 64)
                before = prose() + f"\n-----BEGIN {rng.choice(['CERTIFICATE', 'PUBLIC KEY', 'PGP SIGNATURE'])}-----\n"
                rows.append((value, before, "\n" + pick(b64, 64) + "\n", rng.choice(paths), 0))
            else:  # data without a name
                rows.append((pick(rng.choice([b64, alnum]), rng.randint(18, 80)), rng.choice([prose() + " ", "data:image/png;base64,", "src=", "integrity=sha384-"]), rng.choice([" ", "\n", '"']) + prose(), rng.choice(paths), 0))
        elif k % 6 == 1:
            word_like = lambda: rng.choice([word() + word() + pick(string.digits, rng.randint(1, 4)), word().capitalize() + pick(string.digits, 4) + pick("!?#$", 1), word() + word()])
            signs = alnum + ".!@:#$%^&*-_~"
            value = rng.choice([lambda: pick(alnum, rng.randint(6, 15)), lambda: pick(signs, rng.randint(6, 24)), lambda: pick(string.ascii_letters, rng.randint(8, 32)), lambda: pick(string.digits, rng.randint(4, 12)), word_like, word_like, lambda: pick(string.ascii_uppercase, rng.randint(3, 12)) + pick(string.ascii_lowercase, rng.randint(3, 16))])()
            if rng.random() < 0.25:
                value = "".join(ch for ch in value if ch not in "@:#?/") + pick(alnum, 3)
                before, after = f"{prose()} {rng.choice(['postgres', 'https', 'redis', 'mysql', 'amqp'])}://{rng.choice(['', word()])}:", f"@{word()}/{word()}"
            else:
                plainly = value.islower() and value.isalpha()
                before = f"{prose()} {rng.choice(names)}{rng.choice([joint, ' is ' if not plainly else joint])}{quote}"
                after = quote + rng.choice([" ", "\n"]) + prose()
            rows.append((value, before, after, rng.choice(paths[:7]), 1))
        elif k % 6 == 4:
            kind = rng.randrange(4)
            if kind == 0:
                value, before = rng.choice([word(), rng.choice(["the", "that", "this", "a", "not", "with", "your"])]), f"{prose()} {rng.choice(names + ['the secret', 'bearer'])}{rng.choice([' is ', ' is '])}"
                before = before if rng.random() < 0.7 else f"{prose()} bearer "
            elif kind == 1:
                value = rng.choice(["required", "None", "null", "string", "optional", "true", "false", "redacted", "hidden", "undefined", "String", "REDACTED", "changeme", "example", "your-password-here", "YOUR_API_KEY_HERE", "example.com", "test-value"])
                before = f"{prose()} {rng.choice(names)}{joint}{quote}"
            elif kind == 2:
                value = rng.choice(["${" + word().upper() + "_KEY", "os.environ[", f"get_{word()}(", f"{word()}.{word()}(", f"self.{word()}(", "$" + word().upper(), "{{ " + word(), "*" * rng.randint(4, 12), f"${{{word()}.{word()}", "get" + word().capitalize() + "(", "process.env[", f"config[{word()}"])
                before = f"{prose()} {rng.choice(names)}{joint}"
                quote = ""
            else:
                value, before = "-".join([word(), word()]), f"{prose()} the {rng.choice(names)} is "
            rows.append((value, before, rng.choice([" ", ". ", quote + " "]) + prose(), rng.choice(paths), 0))
        elif k % 2:
            value = rng.choice([lambda: pick(hexes, rng.choice([32, 40, 40, 64])), lambda: pick(hexes, 40).upper(), lambda: pick(alnum, rng.randint(20, 48)), lambda: pick(b64, rng.randint(24, 60)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)])()
            known = value.startswith(("AKIA", "ghp_", "sk_live", "xoxb"))
            before = f"{prose()} " if known and rng.random() < 0.3 else f"{prose()} {rng.choice(names)}{joint}{quote}"
            rows.append((value, before, quote + " " + prose(), rng.choice(paths[:7]), 1))
        else:
            kind = rng.randrange(8)
            if kind == 0:
                value, before = pick(hexes, rng.choice([32, 40, 64])), f"{prose()} {rng.choice(plain)}{rng.choice([' ', ': ', ' = ', '='])}"
            elif kind == 1:
                value, before = pick(string.digits, rng.randint(16, 24)), f"{prose()} "
            elif kind == 2:
                value, before = "-".join(pick(hexes, x) for x in (8, 4, 4, 4, 12)), f"{prose()} {rng.choice(['id ', 'uuid: ', '', 'session '])}"
            elif kind == 3:
                value = rng.choice(["your-token-here-", "example_value_", "placeholder_key_", "changeme-default-", "dummy_test_sample_"]) + pick(string.digits, rng.randint(1, 4))
                before = f"{prose()} {rng.choice(names)}{joint}{quote}"
            elif kind == 4:
                value, before = "_".join([word(), word(), word()]) + pick(string.digits, 2) + "_page_index", f"{prose()} "
            elif kind == 5:
                value, before = "/".join(["2024", "05", word(), word() + "-" + word()]) + "/article", f"{prose()} "
            elif kind == 6:
                value, before = pick(hexes, rng.choice([16, 32, 40, 64])), f"{prose()} "
            else:
                name = rng.choice([str.upper, str.lower])("_".join([word() + word(), str(rng.randint(1, 99)), word(), rng.choice(names)]))
                rows.append((pick(alnum, 20), f"{prose()} {name}{joint}{quote}", quote + "\n" + prose(), rng.choice(paths), 1))
                continue
            rows.append((value, before, rng.choice([" ", ". ", quote + " "]) + prose(), rng.choice(paths), 0))
    return rows


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple | float:
    """A tree as nested (feature, threshold, left, right); leaves are the share of secrets."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return round(float((y.sum() + 0.5) / (len(y) + 1)), 4)
    best = (1e-9, 0, 0.0)
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    whole = gini(y)
    for f in rng.choice(x.shape[1], max(4, x.shape[1] // 3), replace=False):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2
        for t in cuts if len(cuts) <= 24 else cuts[np.linspace(0, len(cuts) - 1, 24).astype(int)]:
            left = x[:, f] <= t
            gain = whole - gini(y[left]) - gini(y[~left])
            if gain > best[0]:
                best = (gain, int(f), float(t))
    if best[0] <= 1e-9:
        return round(float((y.sum() + 0.5) / (len(y) + 1)), 4)
    _, f, t = best
    left = x[:, f] <= t
    return f, round(t, 6), _grow(x[left], y[left], rng, depth - 1), _grow(x[~left], y[~left], rng, depth - 1)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 6, seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    return [_grow(x[at], y[at], rng, depth) for at in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def tree_sql(tree: tuple | float, v: str) -> str:
    """The tree over an array of features named ``v``."""
    if not isinstance(tree, tuple):
        return f"{tree}D"
    f, t, left, right = tree
    return f"if({v}[{f}] <= {t}D, {tree_sql(left, v)}, {tree_sql(right, v)})"


def _candidates(rows: DataFrame, *carried: str) -> DataFrame:
    """One row per candidate of rows with a text t: what is carried, at, c, b and a (the text on either side), start."""
    each = f"transform(_c, (c, i) -> struct(c AS c, {_before('_c', '_s', 'i')} AS b, left(_s[i + 1], 16) AS a, char_length(_s[i]) AS gap))"
    cut = _cut(rows.withColumn("row", F.monotonically_increasing_id()), "t").select("row", *carried, F.posexplode(F.expr(each)).alias("at", "f"))
    run = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = cut.withColumn("length", F.char_length("f.c")).withColumn("start", F.sum(F.col("f.gap") + F.col("length")).over(run) - F.col("length"))
    return spans.select(*carried, "f.c", "f.b", "f.a", "start", "length")


def training_rows(spark: SparkSession, found: list[tuple[str, str, str, str, int]]) -> DataFrame:
    """Candidates that the scan cuts from the findings' texts: x (features), y (1 if it meets the secret), whole (it is the
    labelled value and no more), n (the finding)."""
    values = ", ".join(f"({k}, {_quoted(b + v + a)}, {_quoted(p)}, {len(b)}, {len(v)}, {y})" for k, (v, b, a, p, y) in enumerate(found))
    rows = _candidates(spark.sql(f"SELECT * FROM VALUES {values} AS t(n, t, path, at_, size, y)"), "n", "path", "at_", "size", "y")
    meets = "start < at_ + size AND at_ < start + length"
    return rows.selectExpr("n", f"array({', '.join(features('c', 'b', 'a', 'path'))}) AS x", f"if({meets}, y, 0) AS y", "start = at_ AND length = size AS whole")


@functools.lru_cache(4)
def _forest_sql(spark: SparkSession, trees: int, depth: int) -> str:
    rows = training_rows(spark, labelled_findings()).orderBy("n", "x").collect()  # bounded by the generator
    forest = grow_forest(np.array([r.x for r in rows]), np.array([r.y for r in rows], float), trees, depth)
    return "(" + " + ".join(tree_sql(t, "v") for t in forest) + f") / {len(forest)}"


def score_sql(spark: SparkSession, c: str, before: str, after: str, path: str, trees: int = 16, depth: int = 6) -> str:
    """SQL of the forest's share of votes that a candidate is a secret."""
    return f"element_at(transform(array(array({', '.join(features(c, before, after, path))})), v -> {_forest_sql(spark, trees, depth)}), 1)"


def _cut(docs: DataFrame, text_col: str, c: str = "_c", s: str = "_s") -> DataFrame:
    """Adds the columns c (candidates) and s (what stands between them, one more; null without candidates)."""
    text = f"`{text_col}`"
    found = f"if({text} rlike {_quoted(HINT)}, regexp_extract_all({text}, {_quoted(CANDIDATE)}, 0), cast(array() AS array<string>))"
    return docs.withColumn(c, F.expr(found)).withColumn(s, F.expr(f"if(size({c}) > 0, split({text}, {_quoted(CANDIDATE)}, -1), cast(null AS array<string>))"))


def _before(c: str, s: str, i: str) -> str:
    """SQL of the text before a candidate, the candidate before it included: that may be the name it is assigned to."""
    return f"right(concat(if({i} > 0, {c}[{i} - 1], ''), {s}[{i}]), {NEAR * 2})"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD, verdicts: bool = False) -> DataFrame:
    """One row per secret: doc_id, start (code points before it), length, secret_sha256, score. Clean rows have none.

    With ``verdicts`` rejected candidates are returned too, and a column is_secret. Null and empty texts have none; a
    null path is an empty one; rows that repeat give their findings each; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS t", f"coalesce(cast(`{path_col}` AS string), '') AS path").filter(f"t rlike {_quoted(HINT)}")
    cut = _candidates(rows, "doc_id", "path")
    scored = cut.selectExpr("doc_id", "start", "cast(length AS bigint) AS length", "sha2(cast(c AS binary), 256) AS secret_sha256", f"{score_sql(spark, 'c', 'b', 'a', 'path')} AS score")
    return scored.withColumn("is_secret", F.col("score") >= threshold) if verdicts else scored.filter(F.col("score") >= threshold)


def mask_secrets(docs: DataFrame, text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """``docs`` with secrets in the text replaced; rows, order of columns and other columns, whatever their names, stay as
    they are. Null and empty texts stay null and empty, a null path is an empty one; texts are read whole, however long;
    an empty table gives no rows."""
    spark = docs.sparkSession
    c, s, p = unused(docs, "_c", "_s", "_p")
    cut = _cut(docs.withColumn(p, F.expr(f"coalesce(cast(`{path_col}` AS string), '')")), text_col, c, s)
    piece = f"transform({c}, (c, i) -> concat({s}[i], if({score_sql(spark, 'c', _before(c, s, 'i'), f'{s}[i + 1]', p)} >= {threshold}D, {_quoted(mask)}, c)))"
    masked = f"if(size({c}) > 0, concat(array_join({piece}, ''), element_at({s}, -1)), `{text_col}`)"
    return cut.withColumn(text_col, F.expr(masked)).select(*map(column, docs.columns))
