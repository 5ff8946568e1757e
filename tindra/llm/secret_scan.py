"""Secret scans: patterns find candidates, a random forest removes false positives.

All of the scan is DataFrame functions.  One pattern finds candidates; the text is split by it, so the
text before and after each is at hand.  A candidate's statistics - length, runs of one character class,
dictionary coverage, distinct characters, path and neighbouring words, known prefixes - are Column
expressions, and the forest, trained once on the driver, is a sum of nested CASE expressions over them.

The forest learns from labelled findings, ``TRAIN_FINDINGS`` of them, drawn from a fixed seed: keys of
known makes, random tokens and passwords in assignments on one side; digests, commit ids, paths, serial
numbers, placeholders and compound words in running text on the other.  Their statistics come from the
same expressions.

Semantics: null and empty texts have no findings; findings are in text order; a secret that stands in
many rows is found in each; a name that tells a secret has at most two further parts of twelve
characters (``SECRET_KEY_ID``) and eight blanks before its sign; all rows and columns are kept; an empty table gives no rows; columns named
like the results are overwritten.
"""

from __future__ import annotations

import json
import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.llm import shared
from tindra.llm.pii import quoted

TRAIN_FINDINGS, TREES, DEPTH, LEAST, CUT = 3000, 15, 5, 8, 0.5
PLACES = 64  # findings of a text whose lengths are summed first, so a place takes a short sum of sums
CONTEXT = 48  # characters before and after that count as neighbouring words

# Forms of known makes, words that name secrets, and words that do not.
MAKES = {
    "aws_key": "AKIA[0-9A-Z]{16}",
    "github_token": "gh[pousr]_[A-Za-z0-9]{36,}",
    "stripe_key": "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "slack_token": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": "AIza[0-9A-Za-z_-]{35}",
    "jwt": "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
    # the whole block; without an end mark the lines of 40 characters or more that follow
    "private_key": "-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----(?:[A-Za-z0-9+/=\\s\\\\:,]*+(?:-(?!----)[A-Za-z0-9+/=\\s\\\\:,]*+){0,16}-----END (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----|(?:\\s{1,8}[A-Za-z0-9+/=]{40,}+)*+)",
}
NAMED = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|passphrase"
BENIGN = "sha1|sha256|sha|md5|commit|digest|checksum|hash|uuid|guid|version|build|isbn|serial|revision|etag|sample|example|placeholder|article|figure|order"
DICTIONARY = "password placeholder example changeme secret token sample license version default internal external network document settings config system server client public private number string value field table index chapter section figure article country history science general common between through because before after under other about first their there which would could should these those where while great world state house place right small found still every three never again being using user name file path data true false null test dummy your here with from that this have they been will more when what some time into only also than then them very like over such just most even made back much good well work life year hand part week case point home water room mother area money story fact month lot study book eye job word business issue side kind head".split()
_CHARS = "A-Za-z0-9+/_-"
_ASSIGNS = f"(?i:{NAMED})(?:[_-][A-Za-z0-9]{{1,12}})?(?:[_-][A-Za-z0-9]{{1,12}})?\\s{{0,8}}[=:]"
_MADE = f"(?<![A-Za-z0-9])(?=[AgsrxeA-])(?:{'|'.join(MAKES.values())})"
# the cheap looks back and ahead come first, so few places come to the long ones
CANDIDATE = "|".join(
    [
        _MADE,
        f"(?<=[=:\\s\"'])(?<=[=:]|[=:\\s][\\s\"'])(?<=[=:]\\s{{0,8}}[\"']?)(?<={_ASSIGNS}\\s{{0,8}}[\"']?)[^\\s\"',;]{{6,}}+",
        f"(?<![{_CHARS}])(?=[{_CHARS}]{{14}})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[{_CHARS}]{{14,}}+={{0,2}}",
    ]
)
MAY_HOLD = f"[0-9]|[=:](?<={_ASSIGNS})|{_MADE}"
FEATURES = {
    "length": "length(v)",
    "runs": "length(regexp_replace(v, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+', '#')) / length(v)",
    "covered": f"1 - length(regexp_replace(lower(v), {quoted('|'.join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))))}, '')) / length(v)",
    "distinct": "size(array_distinct(split(v, ''))) / length(v)",
    "digits": "length(regexp_replace(v, '[^0-9]', '')) / length(v)",
    "upper": "length(regexp_replace(v, '[^A-Z]', '')) / length(v)",
    "hex": "if(v rlike '^[0-9a-fA-F-]+$', 1, 0)",
    "letters_run": "array_max(transform(split(v, '[^a-zA-Z]+'), x -> length(x))) / length(v)",
    "path": "length(regexp_replace(v, '[^/._-]', '')) / length(v)",
    "in_path": "if(b rlike '(?:/|\\\\\\\\|://\\\\S*|\\\\.)$' or a rlike '^(?:/|\\\\.[a-z]|\\\\\\\\)', 1, 0)",
    "assigned": "if(b rlike '[=:]\\\\s*[\"\\']?$', 1, 0)",
    "named": f"if(b rlike {quoted(f'(?i)(?:{NAMED})[^\\n]{{0,16}}$')}, 1, 0)",
    "benign": f"if(b rlike {quoted(f'(?i)(?:{BENIGN})[^\\n]{{0,16}}$')}, 1, 0)",
    "make": f"if(v rlike {quoted('^(?:' + '|'.join(MAKES.values()) + ')$')}, 1, 0)",
    "filler": "if(lower(v) rlike 'x{4}|0{5}|1234|abcd|example|changeme|dummy|sample|placeholder|your[_-]|^\\\\W*(.)\\\\1+\\\\W*$', 1, 0)",
}


def labelled_findings(n: int = TRAIN_FINDINGS, seed: int = 11) -> list[dict]:
    """Findings with the text before and after, and whether they are secrets."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    alnum, hexa, words = string.ascii_letters + string.digits, "0123456789abcdef", DICTIONARY
    text = lambda k: " ".join(rng.choices(words, k=k))
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "SECRET_KEY", "client_secret"]

    def assigned() -> str:
        return f"{text(4)} {rng.choice(names)}{rng.choice(['=', ': ', ' = ', '=' + chr(34), ' = ' + chr(34), ': ' + chr(39)])}"

    true = (
        lambda: (f"{text(4)} ", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)),
        lambda: (assigned(), "AKIA" + pick(string.ascii_uppercase + string.digits, 16)),
        lambda: (rng.choice([f"{text(3)} ", assigned()]), "gh" + pick("pousr", 1) + "_" + pick(alnum, 36)),
        lambda: (rng.choice([f"{text(3)} ", assigned()]), rng.choice(["sk_live_", "rk_live_"]) + pick(alnum, 24)),
        lambda: (rng.choice([f"{text(3)} ", assigned()]), "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24)),
        lambda: (f"{text(3)} ", "AIza" + pick(alnum + "_-", 35)),
        lambda: (rng.choice(["Authorization: Bearer ", f"{text(2)} "]), "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 30)),
        lambda: (f"{text(3)} ", "-----BEGIN RSA PRIVATE KEY-----" + rng.choice(["", f"\n{pick(alnum + '+/', 64)}\n{pick(alnum + '+/', 64)}\n{pick(alnum, 20)}==\n-----END RSA PRIVATE KEY-----"])),
        lambda: (assigned(), pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (assigned(), pick(hexa, rng.choice([18, 40]))),
        lambda: (assigned(), pick(alnum, rng.randint(14, 48))),
        lambda: (assigned(), pick(alnum + "+/", 40) + "="),
        lambda: (assigned(), pick(alnum + "!#$%&*@^", rng.randint(8, 20))),
    )
    false = (
        lambda: (f"{text(3)} {rng.choice(['sha1', 'commit', 'sha256:', 'md5', 'digest', 'checksum', 'hash:', 'revision'])} ", pick(hexa, rng.choice([16, 32, 40, 64]))),
        lambda: (f"{text(3)} {rng.choice(['uuid', 'guid=', 'id ', 'build'])} ", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (f"{text(5)} ", "-".join(rng.choices(words, k=3)) + "-" + pick(string.digits, 2)),
        lambda: (f"{text(5)} ", "_".join(rng.choices(words, k=3)) + pick(string.digits, 1)),
        lambda: (f"{text(3)} https://www.{rng.choice(words)}.org/", "/".join(rng.choices(words, k=3)) + "/" + pick(string.digits, 4)),
        lambda: (f"{text(3)} /usr/", "/".join(rng.choices(words, k=3)) + pick(string.digits, 2)),
        lambda: (assigned(), rng.choice(["changeme", "your_password_here1", "example-secret-123456", "xxxxxxxxxxxxxxxx", "placeholder123456", "dummy_token_1234", "<password>", "${PASSWORD}", "00000000000000000000a", "********"])),
        lambda: (assigned(), "_".join(rng.choices(words, k=2)) + rng.choice(["", "1"])),
        lambda: (f"{text(3)} {rng.choice(['serial', 'order', 'isbn', 'version'])} ", pick(string.ascii_uppercase, 2) + pick(string.digits, 13)),
        lambda: (f"{text(5)} ", rng.choice(words) + pick(string.digits, 4) + rng.choice(words) + rng.choice(words)),
        lambda: (f"{text(5)} ", pick(string.digits, 8) + "T" + pick(string.digits, 6) + "Z-" + pick(string.digits, 3)),
        lambda: (f"{text(4)} ", pick(hexa, rng.choice([16, 20, 32, 40]))),
    )
    out = []
    for k in range(n):
        label = k % 2
        before, value = rng.choice(true if label else false)()
        out.append({"b": before[-CONTEXT:], "v": value, "a": f" {text(2)}", "label": label})
    return out


def _features(value: str) -> str:
    """SQL: the statistics of a struct expression with the fields b, v and a."""
    return f"get(transform(array({value}), c -> get(transform(array(c.v), v -> get(transform(array(c.b), b -> get(transform(array(c.a), a -> struct({', '.join(f'cast({e} as double) as {k}' for k, e in FEATURES.items())})), 0)), 0)), 0)), 0)"


def grow_forest(x: np.ndarray, y: np.ndarray, seed: int = 4) -> list:
    """Bagged trees as nested tuples (feature, threshold, left, right) with leaf probabilities."""
    rng = np.random.default_rng(seed)
    some = max(1, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, depth: int):
        p = float(y[rows].mean())
        if depth == 0 or len(rows) < 2 * LEAST or p in (0.0, 1.0):
            return p
        best = None
        for f in rng.permutation(x.shape[1])[:some]:
            col = x[rows, f]
            order = np.argsort(col, kind="stable")
            s, t = col[order], y[rows][order]
            left = np.cumsum(t)[:-1]
            n = np.arange(1, len(t))
            ok = (s[1:] > s[:-1]) & (n >= LEAST) & (len(t) - n >= LEAST)
            if not ok.any():
                continue
            pl, pr = left / n, (t.sum() - left) / (len(t) - n)
            gini = np.where(ok, n * pl * (1 - pl) + (len(t) - n) * pr * (1 - pr), np.inf)
            k = int(np.argmin(gini))
            if best is None or gini[k] < best[0]:
                best = (gini[k], int(f), float((s[k] + s[k + 1]) / 2))
        if best is None:
            return p
        _, f, cut = best
        go = x[rows, f] <= cut
        return f, cut, grow(rows[go], depth - 1), grow(rows[~go], depth - 1)

    return [grow(rng.integers(0, len(y), len(y)), DEPTH) for _ in range(TREES)]


def _tree_sql(node, names: list[str]) -> str:
    if not isinstance(node, tuple):
        return f"{node!r}D"
    f, cut, left, right = node
    return f"case when f.{names[f]} <= {cut!r}D then {_tree_sql(left, names)} else {_tree_sql(right, names)} end"


def forest_sql(forest: list, names: list[str]) -> str:
    """SQL: the forest's mean probability for a struct ``f`` of statistics."""
    return "(" + " + ".join(_tree_sql(t, names) for t in forest) + f") / {len(forest)}D"


@lru_cache(maxsize=1)
def _trained(application: str) -> str:
    spark = SparkSession.getActiveSession()
    findings = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(labelled_findings())), "array<struct<b:string,v:string,a:string,label:int>>")).alias("c"))
    rows = findings.select(F.expr(_features("c")).alias("f"), "c.label").select("f.*", "label").collect()  # TRAIN_FINDINGS rows
    names = list(FEATURES)
    x, y = np.array([[r[n] for n in names] for r in rows]), np.array([r["label"] for r in rows], float)
    return forest_sql(grow_forest(x, y), names)


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All rows and columns with ``findings``: array of struct start (character, from 0), kind, length,
    digest (SHA-256 of the value), score, secret (score >= CUT); and ``redacted``, the text with the
    secrets replaced by their kind."""
    model = _trained(docs.sparkSession.sparkContext.applicationId)
    kinds = " ".join(f"when c.v rlike {quoted('^(?:' + p + ')$')} then '{k}'" for k, p in MAKES.items())
    text = F.col(text_column)
    may = text.rlike(MAY_HOLD)
    none = F.array().cast("array<string>")
    own = shared.own_prefix(docs)
    values, gaps, contexts, lengths, sums, starts, scores = (own + x for x in ("values", "gaps", "contexts", "lengths", "sums", "starts", "scores"))
    staged = docs.withColumn(values, F.when(may, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    staged = staged.withColumn(gaps, F.when(F.size(values) > 0, F.split(text, CANDIDATE, -1)).otherwise(none))
    context = f"""transform({values}, (v, i) -> named_struct('b', right(if(i = 0, '', concat(element_at({values}, greatest(i, 1)), '')) || get({gaps}, i), {CONTEXT}), 'v', v, 'a', left(get({gaps}, i + 1), {CONTEXT})))"""
    staged = staged.withColumn(contexts, F.expr(context))
    staged = staged.withColumn(lengths, F.expr(f"transform({values}, (v, i) -> length(v) + length(get({gaps}, i)))"))
    staged = staged.withColumn(sums, F.expr(f"if(size({lengths}) = 0, array(0), transform(sequence(0, cast((size({lengths}) - 1) / {PLACES} as int)), k -> aggregate(slice({lengths}, k * {PLACES} + 1, {PLACES}), 0, (t, x) -> t + x)))"))
    total = lambda array, first, n: f"aggregate(slice({array}, {first} + 1, {n}), 0, (t, x) -> t + x)"
    block = f"cast(floor(i / {PLACES}) as int)"
    places = f"transform({values}, (v, i) -> {total(sums, '0', block)} + {total(lengths, f'{block} * {PLACES}', f'i - {block} * {PLACES}')} + length(get({gaps}, i)))"
    staged = staged.withColumn(starts, F.expr(places))
    scored = staged.withColumn(scores, F.expr(f"transform(transform({contexts}, c -> {_features('c')}), f -> {model})"))
    kind = f"case {kinds} when c.b rlike {quoted(f'(?i)(?:{NAMED})[^\\n]{{0,16}}$')} then 'assigned_secret' else 'token' end"
    findings = f"transform({contexts}, (c, i) -> named_struct('start', get({starts}, i), 'kind', {kind}, 'length', length(c.v), 'digest', sha2(c.v, 256), 'score', get({scores}, i), 'secret', get({scores}, i) >= {CUT}D))"
    out = scored.withColumn("findings", F.expr(findings))
    redacted = F.expr(f"array_join(flatten(transform({gaps}, (g, i) -> array(g, coalesce(if(get(findings, i).secret, concat('[', upper(get(findings, i).kind), ']'), get({values}, i)), '')))), '')")
    return out.withColumn("redacted", F.when(F.exists("findings", lambda f: f["secret"]), redacted).otherwise(text)).drop(values, gaps, contexts, lengths, sums, starts, scores)
