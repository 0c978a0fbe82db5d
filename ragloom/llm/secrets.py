"""Secret scans: candidates by shape, a random forest that removes false positives.

Every run of key-like characters that is long enough is a candidate if it mixes letters and digits or is assigned to a
name; so are shorter values of any characters that are assigned to the name of a secret, and the passwords of URLs.
Candidates may overlap. The forest judges a candidate's length, the transitions between its characters, how much of it common words cover,
whether it is part of a path, and the words beside it. It learns from labelled findings that are made by rule: values
of known kinds set between words of the corpus.
"""

import random
import re
import string
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.store import materialise

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.\-]{16,}")
#: Names that a secret is assigned to, and names of values that look alike and are none.
SECRET_NAMES = ("token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "access_key", "private")
OTHER_NAMES = ("sha", "sha1", "sha256", "md5", "commit", "hash", "checksum", "digest", "uuid", "guid", "id", "etag", "version", "rev", "build", "file", "image", "path")
#: The name of a secret and the sign of an assignment. A name may begin within a longer one.
ASSIGNED = re.compile(
    r"""(?:(?i:password|passwd|pwd|secret|token|api_?key|access_?key|credentials?|bearer)|(?<![A-Za-z])(?i:key|auth|private)|(?<=[a-z])(?:Key|Auth))"""
    r"""["'`\]]{0,2}[ \t]{0,8}(?:=>|:=|={1,2}|:)[ \t]{0,8}"""
)
#: Characters of an assigned value: at least, and at most in quotes.
SHORTEST, QUOTED = 6, 1000
_VALUE_END = re.compile(r"""[\s"'`]|\Z""")
#: The password of a URL: what stands between user and host.
LOGIN = re.compile(r"""://[^\s/:@"'<>]{0,256}:(?=([^\s/"'<>]{1,256})@[^\s@/"'<>])""")
_PAIRED = {")": "(", "]": "[", "}": "{", ">": "<"}
_QUOTES = ('"', "'", "`")
#: Labelled findings made for training, and the most frequent words of the corpus that these and the features use: bounds at any input size.
FINDINGS, WORDS = 6000, 4000
THRESHOLD = 0.5
FEATURES = ("length", "digits", "upper", "distinct", "entropy", "transitions", "bigrams", "hex", "covered", "slashes", "dots", "assigned", "quoted", "secret_name", "other_name", "address", "placeholder", "password_name", "login", "symbols", "code")
PASSWORD_NAMES = ("password", "passwd", "pwd")
_PLACEHOLDERS = ("example", "your", "xxxx", "placeholder", "changeme", "dummy", "sample", "test")


#: What a value has that is read from elsewhere: a call, an index, a template, a variable, a member.
_CODE = re.compile(r"[\w\]]\(|\w\[|[$#]?\{|^[$<%&*]|^[A-Za-z_]+(?:(?:\.|::|->)[A-Za-z_]+)+$|^\*+$")


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(before: str, value: str, after: str, bigrams: dict[str, float], common: frozenset) -> list[float]:
    """The numbers named in FEATURES of a candidate between up to 40 characters on either side."""
    n = len(value)
    low = value.lower()
    counts = [value.count(c) for c in set(value)]
    covered, i = 0, 0
    while i < n - 3:
        word = next((w for w in range(min(10, n - i), 3, -1) if low[i : i + w] in common), 0)
        covered += word
        i += word or 1
    near = re.findall(r"[a-z0-9_]+", before.lower())[-3:]
    return [
        float(n), sum(map(str.isdigit, value)) / n, sum(map(str.isupper, value)) / n, len(counts) / n, -sum(c / n * log2(c / n) for c in counts),
        sum(_kind(a) != _kind(b) for a, b in zip(value, value[1:], strict=False)) / n,
        sum(bigrams.get(low[i : i + 2], -9.0) for i in range(n - 1)) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))), covered / n, value.count("/") / n, value.count(".") / n,
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)),
        float(any(w in SECRET_NAMES or w.endswith(("key", "token", "secret", "password")) for w in near)),
        float(any(w in OTHER_NAMES for w in near)), float(before[-1:] in ("@", "/") or before.endswith("://")), float(any(p in low for p in _PLACEHOLDERS)),
        float(any(w.endswith(PASSWORD_NAMES) for w in near)), float(bool(re.search(r"://[^\s/:@]*:$", before)) and after[:1] == "@"),
        sum(not c.isalnum() for c in value) / n, float(bool(_CODE.search(value))),
    ]


def labelled_findings(words: list[str], many: int = FINDINGS, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label) made by rule from words of the corpus; the same for the same words."""
    r = random.Random(seed)
    words = words or ["the", "of", "and"]
    pick = lambda n: " ".join(r.choice(words) for _ in range(n))
    chars = lambda of, n: "".join(r.choice(of) for _ in range(n))
    hexes, base = "0123456789abcdef", string.ascii_letters + string.digits

    def value() -> str:
        kind = r.randrange(7)
        got = [lambda: chars(hexes, r.choice((32, 40, 40, 48, 64))), lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + chars(base, 36), lambda: "sk-" + chars(base, r.randrange(24, 48)), lambda: chars(base + "+/", r.randrange(24, 64)) + "=", lambda: chars(base, r.randrange(16, 40)), lambda: "-".join(chars(base, 8) for _ in range(4))][kind]()
        return got.upper() if r.random() < 0.1 else got

    def short() -> str:
        """A password: drawn characters, or words with digits and symbols."""
        symbols = "!@#$%^&*-_+=?.,:;~"
        word = lambda: r.choice(words).translate(r.choice((str.maketrans("", ""), str.maketrans("aeios", "43105"), str.maketrans("aeo", "@30"))))
        ways = (
            lambda: chars(base + symbols, r.randrange(6, 20)), lambda: chars(base, r.randrange(6, 16)),
            lambda: r.choice((str, str.capitalize))(word()) + r.choice(("", *symbols)) + str(r.randrange(10 ** r.randrange(1, 5))) + r.choice(("", "", *symbols)),
            lambda: r.choice(("-", "_", "!", "", "#")).join(word().capitalize() for _ in range(2)) + str(r.randrange(100)),
        )
        return next(v for v in iter(lambda: r.choice(ways)(), None) if len(v) >= 6)

    def plain() -> str:
        """What is assigned to the name of a secret and is none: words, code, placeholders, numbers."""
        w = lambda: r.choice(words)
        ways = (
            w, lambda: w() + r.choice("-_.") + w(), lambda: pick(r.randrange(2, 5)), lambda: f"{w()}.{w()}", lambda: f"{w()}({w()})", lambda: f"get_{w()}()", lambda: f"{w()}[{w()}]",
            lambda: "${" + w().upper() + "}", lambda: "{{ " + w() + " }}", lambda: "<" + w() + ">", lambda: r.choice(("*", "x", "X")) * r.randrange(6, 12), lambda: f"os.environ['{w().upper()}']",
            lambda: r.choice(("string", "String,", "required", "optional", "undefined", "changeme", "your_password", "your-token", "example", "placeholder", "boolean", "process.env.KEY")),
            lambda: "/" + "/".join(w() for _ in range(3)), lambda: w() + "_" + w() + "_" + w(), lambda: w().capitalize() + w().capitalize(),
        )
        tries = (r.choice(ways)() for _ in range(50))
        return next((v for v in tries if len(v) >= 6), "required")

    def uuid() -> str:
        return "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))

    out = []
    for i in range(many):
        secret = i % 2
        if secret:
            name = r.choice(SECRET_NAMES)
            name = name.upper() if r.random() < 0.2 else r.choice(("", "", "my_", "prod_")) + name
            quote = r.choice(('"', '"', "'", ""))
            link = r.choice((" = ", "=", ": ", " ", ":"))
            before, v, after = f"{pick(3)} {name}{link}{quote}", value(), f"{quote} {pick(2)}"
            kind = r.randrange(6)
            if kind < 2:  # a shorter one, by an assignment only
                name = r.choice((name, *PASSWORD_NAMES, "DB_PASSWORD"))
                before, v = f"{pick(3)} {name}{r.choice((' = ', '=', ': ', ':'))}{quote}", short()
            elif kind == 2:
                scheme = r.choice(("postgres", "mysql", "https", "redis", "mongodb", "ftp", "amqp"))
                before, v, after = f"{pick(2)} {scheme}://{r.choice((r.choice(words), 'user', 'admin', ''))}:", r.choice((short, short, value, lambda: r.choice(words)))(), f"@{r.choice(('host', 'db', r.choice(words)))}:{r.randrange(1000, 9999)}/{r.choice(words)}"
        else:
            kind = r.randrange(11)
            tail = f" {pick(2)}"
            if kind == 0:
                before, v, after = f"{pick(2)} {r.choice(OTHER_NAMES)}{r.choice((' ', ': ', '=', ' = '))}", chars(hexes, r.choice((32, 40, 64))), tail
            elif kind == 1:
                before, v, after = f"{pick(2)} {r.choice(('id', 'uuid', 'guid', ''))} ", uuid(), tail
            elif kind == 2:
                before, v, after = f"{pick(2)} {r.choice(SECRET_NAMES)} = \"", r.choice(("your_api_key_here_1", "xxxxxxxxxxxxxxxx1234", "example-token-000000", "changeme-changeme-1", "placeholder_secret_1")), f"\"{tail}"
            elif kind == 3:
                before, v, after = f"{pick(3)}.{r.randrange(99)}@", f"mail{r.randrange(99)}.example.com", tail
            elif kind == 4:
                before, v, after = f"{pick(2)} {r.choice(('see ', 'https://', 'in /'))}", "/".join(r.choice(words) for _ in range(3)) + f"/{r.choice(words)}{r.randrange(999)}.{r.choice(('py', 'html', 'png'))}", tail
            elif kind == 5:
                before, v, after = f"{pick(3)} ", "".join(r.choice(words) for _ in range(4)) + str(r.randrange(99)), tail
            elif kind == 6:
                before, v, after = f"{pick(3)} ", r.choice("._-=").join(f"{r.choice(words)}{r.randrange(9)}" for _ in range(4)), tail
            elif kind == 7:
                before, v, after = f"{pick(2)} {r.choice(('value', 'total', 'name', 'code'))} = ", r.choice(words) + str(r.randrange(10**14, 10**15)), tail
            elif kind < 10:
                quote = r.choice(('"', "'", "", ""))
                before, v, after = f"{pick(3)} {r.choice(('', 'my_', 'the '))}{r.choice((*SECRET_NAMES, *PASSWORD_NAMES))}{r.choice((' = ', '=', ': ', ': ', ':'))}{quote}", plain(), f"{quote}{tail}"
            else:  # an example of a URL
                before, v, after = f"{pick(2)} {r.choice(('postgres', 'https', 'redis'))}://{r.choice(('user', 'username', '<user>'))}:", r.choice(("<password>", "${PASSWORD}", "{password}", "[password]", "$PASS", "xxxxxx", "your_password", "****")), f"@host/{r.choice(words)}"
            if kind < 8:
                v = re.sub(r"[^A-Za-z0-9+/_=~.\-]", "", v).ljust(16, "0")
        out.append((before[-40:], v, after[:40], secret))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """The spans (start, end) of a text's candidates, each once, ascending; they may overlap."""
    out = set()
    for m in CANDIDATE.finditer(text):
        v, a, b = m[0], *m.span()
        # a name before an equals sign is no part of the value
        cut = v.find("=") + 1
        if 0 < cut < len(v) - 15 and v[: cut - 1].replace("_", "").isalpha():
            v, a = v[cut:], a + cut
        mixed = any(map(str.isdigit, v)) and any(map(str.isalpha, v))
        if mixed or re.search(r"(?i)(?:key|token|secret|password|passwd|pwd)\s*[:=]\s*[\"']?$", text[max(0, a - 40) : a]):
            out.add((a, b))
    out.update(assigned(text))
    out.update(m.span(1) for m in (LOGIN.finditer(text) if "://" in text else ()))
    return sorted(out)


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """Spans of values that are assigned to the name of a secret: what quotes hold, else up to a blank, a quote or the next assignment.

    Values without quotes don't overlap, so that the time is in proportion to the text, whatever it holds.
    """
    end = -1  # of the characters without a blank or quote that were looked at last
    found = ASSIGNED.finditer(text) if "=" in text or ":" in text else iter(())
    m = next(found, None)
    while m:
        a, m = m.end(), next(found, None)
        if text[a : a + 1] in _QUOTES:
            b = text.find(text[a], a + 1, a + 2 + QUOTED) if a < len(text) else -1
            if b > a + SHORTEST and text.find("\n", a, b) < 0:
                yield a + 1, b
                continue
            a += 1
        if a > end:
            end = _VALUE_END.search(text, min(a, len(text))).start()
        b = min(end, m.start()) if m else end
        # punctuation after a value without quotes, and a bracket that was opened before it, are no part of it
        open_, closed, cut = {}, {}, b < end
        while b > a:
            c = text[b - 1]
            if c in _PAIRED:
                if not closed:  # counted once
                    open_, closed = ({c: text.count(c, a, b) for c in side} for side in (_PAIRED.values(), _PAIRED))
                if open_[_PAIRED[c]] >= closed[c]:
                    break
                closed[c] -= 1
            elif c not in ",;." and not (cut and c in "&?|"):
                break
            b -= 1
        if b - a >= SHORTEST:
            yield a, b


class Scanner:
    """A trained forest with the character transitions and common words that its features need."""

    def __init__(self, bigrams: dict[str, float], common: frozenset, forest: RandomForestClassificationModel):
        self.bigrams, self.common, self.forest = bigrams, common, forest


def fit(docs: DataFrame, seed: int = 7) -> Scanner:
    """Train on FINDINGS made findings. The words are the WORDS that most documents of all docs hold; transitions count as often as their words."""
    spark = docs.sparkSession
    words = docs.where("text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,12})"), F.lit(1)))).alias("w"))
    held = [(r["w"], r["n"]) for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(WORDS).collect()]
    top = [w for w, _ in held]
    pairs: dict[str, int] = {}
    for w, n in held:
        for a, b in zip(w, w[1:], strict=False):
            pairs[a + b] = pairs.get(a + b, 0) + n
    total = sum(pairs.values()) or 1
    bigrams = {k: log2(v / total) for k, v in pairs.items()}
    common = frozenset(w for w in top if len(w) > 3)
    rows = [(float(y), features(b, v, a, bigrams, common)) for b, v, a, y in labelled_findings(top, seed=seed)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["label", "numbers"]), "label double, numbers array<double>").coalesce(1).select("label", array_to_vector("numbers").alias("features"))
    forest = RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed).fit(frame)
    return Scanner(bigrams, common, forest)


def findings(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """A row for each candidate of each whole text: doc_id, body (hash of the text), start, end (code points), value, probability.

    Null and empty texts have no candidates; rows that are alike give rows that are alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((scanner.bigrams, scanner.common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bigrams, common = shared.value
        names = ["doc_id", "body", "start", "end", "value", "numbers"]
        for batch in batches:
            rows = []
            for doc_id, body, text in zip(batch["doc_id"], batch["body"], batch["text"], strict=True):
                if text is None:
                    continue
                rows += [(None if pd.isna(doc_id) else int(doc_id), body, a, b, text[a:b], features(text[max(0, a - 40) : a], text[a:b], text[b : b + 40], bigrams, common)) for a, b in candidates(text)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    found = rows.mapInPandas(run, "doc_id long, body long, start int, end int, value string, numbers array<double>")
    judged = scanner.forest.transform(found.withColumn("features", array_to_vector("numbers")))
    return judged.select("doc_id", "body", "start", "end", "value", vector_to_array("probability")[1].alias("probability"))


#: Redactions are sent to every task if they are at most so many rows; beyond that texts and redactions meet in a sorted join.
MOST_SENT = 100_000


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the found spans (body, start, end) replaced by the mark; columns as in docs, n_chars, if there, follows the text.

    Spans that overlap get one mark. Null and empty texts and texts without spans stay as they are, equal texts change alike; an
    empty table gives an empty result. docs may have columns of any name.
    """
    found = materialise(found.select("body", "start", "end"), "found")  # one scan, though it is counted and joined
    spans = found.groupBy(F.col("body").alias("of_body")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    if found.count() <= MOST_SENT:
        spans = F.broadcast(spans)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str, of: list) -> str:
            out, at = [], 0
            for s in of:
                if s["start"] >= at:
                    out += [text[at : s["start"]], mark]
                at = max(at, s["end"])  # spans may overlap: these get one mark
            return "".join([*out, text[at:]])

        return pd.Series([t if t is None or s is None else one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names)
    rows = rows.join(spans, F.xxhash64(at["text"]) == F.col("of_body"), "left")
    rows = rows.withColumn("cut", F.when(F.col("gone").isNull(), F.col(at["text"])).otherwise(cut(at["text"], "gone")))
    out = {c: F.col(x) for c, x in at.items()} | {"text": F.col("cut")}
    if "n_chars" in at:
        out["n_chars"] = F.when(F.col("gone").isNull(), F.col(at["n_chars"])).otherwise(F.length("cut").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*(x.alias(c) for c, x in out.items()))
