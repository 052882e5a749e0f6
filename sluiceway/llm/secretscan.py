"""Secret scans: a random forest on candidates' shape and surroundings removes false positives.

Candidates are, the first that fits at a place: a whole block of a private key; a signed web token (three parts, one
finding); the password of a URL; whatever is assigned to a name that announces a secret, of LEAST characters or more; an
access key by its prefix; and runs of LONG or more letters, digits and ``+/_-`` with a digit, or a capital after a small
letter, among them. Features: length, shares of digits, capitals and symbols, transitions between kinds of characters, distinct
characters, coverage by a dictionary of common word parts, forms (hexadecimal, UUID, digits alone, prefixes of public
services, code and placeholders), runs of one character, unpronounceable runs, the words before (those that announce a secret, those that announce
an id or checksum), assignment and quotes, and the path.

The forest is learned from labelled findings (candidate, left, right, path, secret); without a table of them, from those
labelled by hand in findings.py, HAND times each, and those that labelled() makes up from public formats, at most ROWS rows: the
bound of the sample. Both learning and scanning take the features from the same columns. The forest becomes a table of nodes, a
constant of the plan, that higher-order functions walk down.

Native: extraction, features and forest are SQL functions, so a scan is one projection of each text, without a shuffle.

Defined results: null and empty texts have no findings; a candidate that occurs twice in a text is two findings; a text
of any length is scanned whole, and candidates have any length; a null path counts as empty, as does that of a table without the column; an empty table
of labelled findings finds nothing; repeated rows and rows without doc_id are scanned each; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .findings import FINDINGS

LEAST, LONG, ROWS, HAND, TREES, DEPTH, LEAF, CONTEXT = 4, 16, 3600, 8, 15, 6, 4, 48
RUN = "A-Za-z0-9+/_-"
_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
_SIGNED = rf"(?<![{RUN}])eyJ[A-Za-z0-9_-]{{5,}}+\.[A-Za-z0-9_-]{{5,}}+\.[A-Za-z0-9_-]{{5,}}+"
#: What stands before a value and is matched with it.
_USER = r"(?<=[A-Za-z0-9]://)[^\s:/@?#\"']*+:(?=[^\s:/@?#\"']{3,}+@)"
# Names that announce a secret, in English, German, French and Spanish.
_NAMES = r"(?i:pass(?:wor[dt]|wd|phrase|code)|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|kennwort|mot[ _]de[ _]passe|mdp|contrase[ñn]a|clave)"
_ANNOUNCED = rf"{_NAMES}[A-Za-z_]{{0,12}}[\"'`]?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}(?:(?i:bearer|basic) )?[\"'`]?|(?i:bearer) {{1,3}}(?=[.{RUN}]{{16}})"
_VALUE = rf"[^\s\"'`<>]{{{LEAST - 1},}}(?<![,;.)\]}}])|[^\s\"'`<>]{{{LEAST},}}"
_RUN = rf"(?<![{RUN}])(?:(?=[A-Za-z+/_-]*+[0-9])|(?=[A-Z0-9+/_-]*+[a-z][a-z0-9+/_-]*+[A-Z])|(?=A[KS]IA[A-Z0-9]{{16}}))[A-Za-z0-9+/_][{RUN}]{{{LONG - 1},}}={{0,2}}"
BEFORE = rf"(?:{_ANNOUNCED})(?!eyJ[\w-]{{5,}}\.|-----BEGIN|A[KS]IA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|npm_|AIza)"
#: Each alternative looks at its first character before all else.
CANDIDATE = rf"(?=-){_KEY}|(?=e){_SIGNED}|(?<=/){_USER}[^\s:/@?#\"']+|(?=[ABCKMPSTabckmpst]){BEFORE}(?:{_VALUE})|(?=[A-Za-z0-9+/_]){_RUN}"
# Word parts of the dictionary, and words that announce a secret or its opposite.
PARTS = "account admin agent alpha and archive asset author auto back base beta block book build cache card case cent change check class client code col com commit con config content copy count data date default demo dev dir doc down edit end ent error event example file final first fix font form full game get global group guide hand head help here high home host house icon image index info ing input item java job json just key lab lang last left level lib light line link list load local log long low mail main make man map mark media menu ment meta mini mode model module name net new next node note number object off old one open order out over page part path photo place plan play point post pre press price print pro product project public query read real record red ref release report res right role root row sample screen script search section select sent server service set shop side sign site size small source space spec start state step stop store string style sub super support switch system tab table tag task team temp term test text the theme time tion title tool top track type under unit update url use user util value version video view web week white wide window word work world year your zone".split()
SECRET_WORDS = "token|secret|passw|passwd|passphrase|pwd|kennwort|mot[ _]de[ _]passe|mdp|contrase|clave|api_?key|apikey|access_?key|private_?key|auth|bearer|credential|client_secret|encryption_key|signing"
PLAIN_WORDS = "sha1|sha256|sha512|md5|commit|checksum|digest|etag|uuid|guid|revision|hash|blob|tree|order|invoice|tracking|phone|card|isbn|serial|version|build|trace|request|session_id|integrity"
#: How keys of public services begin.
PREFIXES = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}$|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|sk-|npm_|eyJ[\w-]+\.eyJ|-----BEGIN)"
#: What stands where a secret will be, or code that gets one.
PLACEHOLDER = r"(?i)x{4,}|\*{3,}|^\.{3,}|your|example|change_?me|placeholder|dummy|sample|redacted|replace_|insert_|^(?:password|passwd|secret|token|null|none|nil|true|false|undefined|required|optional|string|test)$|[$%]\{|[$%]\(|\{\{|[<>]"
CODE = r"[\w\])]\(|\[|^[a-z_]\w*(?:\.[a-z_]\w*)+|env"
#: The characters that are counted as distinct: those of ASCII that print.
PRINTED = "[!-~]"
PLAIN_PATHS, SECRET_PATHS = "test|example|sample|fixture|doc|readme|mock|lock|vendor|dist|changelog", r"\.env|config|settings|secret|credential|deploy|\.ya?ml|\.pem|\.ini|\.properties"

FEATURES = ["length", "digits", "capitals", "transitions", "distinct", "dictionary", "hex", "uuid", "number", "run", "hard", "secret_words", "plain_words", "assigned", "quoted", "path", "prefix", "symbols", "placeholder", "code", "letters", "url"]


def features(c: Column, left: Column, right: Column, path: Column) -> dict[str, Column]:
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda x, pattern: F.rlike(x, F.lit(pattern)).cast("double")
    near = F.lower(left)
    longest_run = F.aggregate(F.regexp_extract_all(c, F.lit(r"(.)\1{2,}"), F.lit(0)), F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    where = F.lower(F.coalesce(path, F.lit("")))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "transitions": share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[+/_=-])[^+/_=-]"),
        "distinct": F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(PRINTED), F.lit(0)))) / n,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(PARTS), "")) / n,
        "hex": flag(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "uuid": flag(c, "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"),
        "number": flag(c, "^[0-9+_=/-]+$"),
        "run": longest_run / n,
        "hard": F.regexp_count(F.lower(c), F.lit("[bcdfghjklmnpqrstvwxz]{4,}|[bcdfghjklmnpqrstvwxz][0-9][bcdfghjklmnpqrstvwxz]|[0-9][a-z][0-9]")) / n,
        "secret_words": flag(near, SECRET_WORDS),
        "plain_words": flag(near, rf"(?:{PLAIN_WORDS})[^\n]{{0,12}}$"),
        "assigned": flag(left, r"[=:>]\s*[\"'`]?$|(?i)bearer\s$"),
        "quoted": flag(left, "[\"'`]$") * flag(right, "^[\"'`]"),
        "path": flag(where, SECRET_PATHS) - flag(where, PLAIN_PATHS),
        "prefix": flag(c, PREFIXES),
        "symbols": share("[^A-Za-z0-9]"),
        "placeholder": flag(c, PLACEHOLDER),
        "code": flag(c, CODE),
        "letters": flag(c, "^(?:[a-z]+|[A-Z]?[a-z]+)$"),
        "url": flag(left, r"://[^\s/]{0,64}:$"),
    }


def labelled(rows: int = ROWS, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(candidate, left, right, path, secret): findings in the shapes of public formats, half of them secrets."""
    r = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    low, hexa, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    any_ = low + low.upper() + digit
    size = lambda a, b: int(r.integers(a, b))
    words = lambda n: pick(["-", "_", "/", ""]).join(pick(PARTS) for _ in range(n))
    prose = ["see the", "it was", "and then", "of the", "le la de", "und der", "que de", "a line"]
    out = []
    while len(out) < rows:
        name, q = pick(["token", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "TOKEN", "API_KEY", "Secret"]), pick(['"', "'", ""])
        value = pick([chars(hexa, pick([32, 40, 64])), chars(hexa, 40), chars(hexa.upper(), pick([32, 40])), chars(any_, size(20, 48)), "ghp_" + chars(any_, 36), "AKIA" + chars(low.upper() + digit, 16), "sk_live_" + chars(any_, 24), "xoxb-" + chars(digit, 12) + "-" + chars(any_, 24), chars(any_ + "+/", 43) + "="])
        if r.random() < 0.25:  # a short one
            value, name = chars(pick([hexa, any_]), size(16, 25)), pick(["password", "passwd", "pwd", "secret", "PASSWORD"])
        if r.random() < 0.15:  # one that needs no announcement
            value = pick(["AKIA" + chars(low.upper() + digit, 16), "ghp_" + chars(any_, 36), "sk_live_" + chars(any_, 24), "xoxb-" + chars(digit, 12) + "-" + chars(any_, 24), "AIza" + chars(any_, 35)])
            out.append((value, f"{pick(prose)} ", pick([" ", ". ", "\n", "### ", "!!"]), pick(["", "src7", "app/config.yml", "src/main.py"]), 1))
        out.append((value, f"{pick(prose)} {name}{pick([' = ', '=', ': ', ':'])}{q}", q + pick(["", " ", "\n", "### ", "!!"]), pick(["", "app/config.yml", ".env", "src/main.py", "src7", "deploy/settings.ini"]), 1))
        if r.random() < 0.3:  # a password that someone thought of
            parts = [pick(PARTS).capitalize() if r.random() < 0.4 else pick(PARTS) for _ in range(size(1, 3))]
            mixed = chars(any_ + "!#$%&*?@-_", size(6, 16))
            value = pick([pick(["", "-", "_"]).join(parts) + chars(digit, size(1, 5)) + pick(["", "!", "#", "$"]), mixed if len(set(mixed)) > 3 else mixed + "7q", chars(low, size(14, 26))])
            out.append((value, f"{pick(['', pick(prose) + ' '])}{pick(['password', 'PASSWORD', 'db_password', 'passwd', 'secret', 'api_key', 'pwd', 'token'])}{pick([' = ', '=', ': '])}{q}", q + pick(["", " ", "\n"]), pick(["", "app/config.yml", ".env", "src/main.py", "notes.txt"]), 1))
            out.append((pick([pick(PARTS), pick(PARTS), "the", "a_" + pick(PARTS), pick(PARTS) + "." + pick(PARTS), pick(PARTS) + "()", "${" + pick(PARTS).upper() + "}", "your_" + pick(PARTS), "<" + pick(PARTS) + ">"]), f"{pick(prose)} {pick(['password', 'token', 'secret', 'auth', 'api_key'])}{pick([': ', ' = ', ': '])}", pick([" ", "\n", ", "]), pick(["", "docs/readme.md", "src/main.py", "notes.txt"]), 0))
        kind, left, q = size(0, 9), pick(prose) + " ", ""
        if kind == 0:
            value, left = chars(hexa, pick([32, 40, 64])), f"{pick(['commit', 'sha1', 'md5', 'checksum', 'etag', 'sha256', 'digest', 'revision'])}{pick([' ', ': ', '=', ' = '])}"
        elif kind == 1:
            h = chars(hexa, 32)
            value, left = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{pick(['uuid', 'id', 'trace', 'request'])}{pick([' = ', ': ', '='])}"
        elif kind == 2:
            value = chars(digit, size(16, 20))
        elif kind == 3:
            value = f"{words(size(3, 6))}{pick(['', '-', '_'])}{chars(digit, size(1, 5))}"
        elif kind == 4:
            value, left, q = pick(["your_api_key_here_1", "xxxxxxxxxxxxxxxxxxx1", "REPLACE_WITH_TOKEN_1", "0000000000000000000", "changeme_changeme_123", "example_token_123456", "1234567890123456789"]), f"{name} = ", '"'
        elif kind == 5:
            value = f"/{words(2)}/{size(2000, 2030)}/{size(10, 13)}/{words(3)}"
        elif kind == 6:
            value = chars("-=_", size(16, 40)) + chars(digit, 1)
        elif kind == 7:
            value = "".join(pick(PARTS).capitalize() if k else pick(PARTS) for k in range(size(4, 7)))
        elif r.random() < 0.5:
            value = chars(hexa, size(16, 25))
        else:
            value = f"{size(2000, 2030)}-{size(10, 13)}-{size(10, 29)}T{size(10, 24)}-{size(10, 60)}-{size(10, 60)}"
        if value:
            out.append((value, left + q, q + " ", pick(["", "docs/readme.md", "tests/data.json", "src/main.py", "src3", "package-lock.json"]), 0))
    return out[:rows]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A tree by Gini impurity over a random root-sized set of features at each node: a share, or (feature, cut, low, high)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return round(share, 4)
    best = None
    for f in rng.permutation(x.shape[1])[: max(2, int(np.sqrt(x.shape[1])))]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF)
        if not ok.any():
            continue
        a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        gini = np.where(ok, n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
        k = int(gini.argmin())
        if best is None or gini[k] < best[0]:
            best = (gini[k], int(f), float((v[k] + v[k + 1]) / 2))
    if best is None:
        return round(share, 4)
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 3) -> list:
    rng = np.random.Generator(np.random.PCG64(seed))
    return [grow(x[pick], y[pick], rng) for pick in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


NODES = "array<struct<f:int,cut:double,low:int,high:int,share:double>>"


def as_table(trees: list) -> tuple[list[tuple], list[int]]:
    """(nodes, roots): nodes (feature, cut, place of the lower side, of the upper, share) of all trees, a leaf's feature being -1, and where trees begin."""
    nodes: list[tuple] = []

    def put(tree) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, at, at, float(tree)) if not isinstance(tree, tuple) else ())
        if isinstance(tree, tuple):
            f, cut, low, high = tree
            nodes[at] = (f, cut, put(low), put(high), 0.0)
        return at

    return nodes, [put(t) for t in trees]


def score_of(trees: list, x: Column) -> Column:
    """The trees' mean share for an array of features: a walk down each, over a table of nodes, so that code stays small however many there are."""
    nodes, roots = as_table(trees)
    if not roots:
        return F.lit(0.0)
    names = ("f", "cut", "low", "high", "share")
    table = F.from_json(F.lit(json.dumps([dict(zip(names, n)) for n in nodes])), NODES)

    def down(at, _):
        n = F.get(table, at)
        return F.when(n["f"] < 0, at).when(F.get(x, n["f"]) <= n["cut"], n["low"]).otherwise(n["high"])

    steps = F.sequence(F.lit(1), F.lit(DEPTH))
    shares = F.transform(F.array(*map(F.lit, roots)), lambda r: F.get(table, F.aggregate(steps, r, down))["share"])
    return F.aggregate(shares, F.lit(0.0), lambda a, v: a + v) / len(roots)


def learn(findings: DataFrame) -> list:
    """A forest from labelled findings (candidate, left, right, path, secret), at most ROWS of them, those with the smallest hashes; no trees without any."""
    f = features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path"))
    some = C.smallest(findings.select("candidate", "left", "right", "path", "secret"), ["candidate", "left", "right", "path", "secret"], ROWS)
    rows = some.select(*[c.cast("double").alias(k) for k, c in f.items()], F.col("secret").cast("double").alias("secret")).collect()
    if not rows:
        return []
    data = np.array([tuple(r) for r in rows], np.float64)
    return forest(data[:, :-1], data[:, -1])


TABLE = "candidate string, left string, right string, path string, secret int"


def labelled_table(spark) -> DataFrame:
    """The findings labelled by hand, HAND times each, and those made up; all ROWS of them."""
    # A row's copies differ in their path's ending, so that hashes tell them apart.
    hand = [(c, left, right, path + " " * k, y) for k in range(HAND) for c, left, right, path, y in FINDINGS]
    return C.table_of(spark, hand + labelled(ROWS - len(hand)), TABLE)


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """(doc_id, nth, candidate, left, right, path) of all candidates, numbered from 0 in each text."""
    some = docs.select("doc_id", path.alias("path"), C.cut(F.col("text"), CANDIDATE).alias("parts")).where(F.size("parts") > 1)
    around = F.transform("parts", lambda x, i: F.when(i % 2 == 1, F.struct(x.alias("c"), F.get("parts", i - 1).alias("l"), F.get("parts", i + 1).alias("r"))))
    each = some.select("doc_id", "path", F.posexplode(F.filter(around, lambda x: x.isNotNull())).alias("nth", "x"))
    # What announces a value is matched with it, and belongs to what stands before.
    lead = F.when(F.rlike("x.c", F.lit("^-----BEGIN")), "").otherwise(F.regexp_extract("x.c", rf"^(?:{_ANNOUNCED})", 0))
    user = F.when((lead == "") & F.rlike("x.l", F.lit("://$")), F.regexp_extract("x.c", r"^[^:]*:", 0)).otherwise(lead)
    each = each.withColumn("lead", user)
    return each.select("doc_id", "nth", F.substr("x.c", F.length("lead") + 1, F.length("x.c")).alias("candidate"), F.right(F.concat(F.right("x.l", F.lit(CONTEXT)), "lead"), F.lit(CONTEXT)).alias("left"), F.left("x.r", F.lit(CONTEXT)).alias("right"), "path")


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, nth, secret, score) of the candidates that the forest takes for secrets; nth numbers a text's candidates."""
    trees = learn(labelled_table(docs.sparkSession) if findings is None else findings)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    c = candidates(docs, where)
    f = features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path"))
    # Generated, so that the optimiser doesn't write each feature out wherever a tree asks for it.
    wide = c.select("doc_id", "nth", "candidate", F.explode(F.array(F.array(*[f[k].cast("double") for k in FEATURES]))).alias("f"))
    out = wide.select("doc_id", F.col("nth").cast("int").alias("nth"), F.col("candidate").alias("secret"), F.round(score_of(trees, F.col("f")), 4).alias("score"))
    return out.where((F.col("score") >= threshold) & F.lit(bool(trees)))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
