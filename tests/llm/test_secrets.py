import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from tallyframe.llm import secrets


def brute_base(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_against_brute_force():
    r = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", '"', "'", " ", ":", "=", "abc", "short", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "é😀", "\n", "passwd", "ſecret", "toKen"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert secrets.joined(secrets.base_spans(text)) == brute_base(text), text


def test_frame(spark):
    key = "AKIA" + "Q" * 16
    rand = "aB3dE5gH7jK9mN1pQ3sT5vW7"
    rows = [(i, f"key {key} end", f"s{i % 5}", "en") for i in range(10)]
    rows += [(20, f"😀 token = 'abcdef123' {rand} tail", "s1", "en"), (21, None, None, None), (22, "", "s1", "en"), (23, "plain", "s1", "de"), (23, "plain", "s1", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert len(got) == 14 and secrets.find_secrets(docs).count() == 15
    for i, text, *_ in rows:
        assert got[i].base_sha256 == hashlib.sha256(brute_base(text or "").encode()).hexdigest()
    assert got[3].n_access == 1 and (got[3].n_live, got[3].n_copied) == (0, 1) and got[3].spans == "access:4:24"
    assert got[20].spans == "assign:2:20,opaque:22:46" and got[20].n_live == 2
    assert got[21].spans == got[22].spans == "" and got[21].n_live == 0
    assert secrets.find_secrets(docs.limit(0)).collect() == []


def test_widely_copied_token_is_no_span(spark):
    rand = "aB3dE5gH7jK9mN1pQ3sT5vW7"
    docs = spark.createDataFrame([(i, f"x {rand}", f"s{i}") for i in range(5)], "doc_id bigint, text string, source string")
    assert {r.spans for r in secrets.find_secrets(docs).collect()} == {""}


def test_mask(spark):
    rows = [(1, "😀 token = 'abcdef123' then", "a"), (2, "clean", "a"), (3, None, "b"), (4, "token=deadbeefdeadbeefdeadbeef x", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in secrets.mask(docs).collect()}
    assert got == {1: "😀 [secret:assign]' then", 2: "clean", 3: None, 4: "[secret:assign] x"}
    assert secrets.mask(docs).columns == docs.columns


def test_mask_without_ids_and_with_one_id_for_two_texts(spark):
    rows = [(None, "token=abcdef123 x", "a"), (None, "clean", "a"), (1, "token=uvwxyz987 then", "b"), (1, "say token=klmnop555", "b"), (1, "clean", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = [(None, "[secret:assign] x", "a"), (None, "clean", "a"), (1, "[secret:assign] then", "b"), (1, "say [secret:assign]", "b"), (1, "clean", "b")]
    assert sorted(map(str, map(tuple, secrets.mask(docs).collect()))) == sorted(map(str, want))


def brute_spans(text):
    """All candidates as (start, kind, end), by other means than the operator's."""
    base = [(int(a), kind, int(b)) for kind, a, b in (x.split(":") for x in brute_base(text).split(",") if x)]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text):
        t = m[0]
        bits = -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))
        if re.search("[0-9]", t) and re.search("[A-Z]", t) and re.search("[a-z]", t) and bits >= 3.5:
            more.append((m.start(), "opaque", m.end()))
    for i in range(len(text)):
        if text.startswith("://", i) and i and re.match("[A-Za-z0-9+.-]", text[i - 1]):
            m = re.compile(r"[^\s/@:]*:([^\s/@]+)@").match(text, i + 3)
            if m and len(m[1]) >= 3:
                more.append((m.start(1), "url", m.end(1)))
    pem = [(m.start(), "pem", m.end()) for m in re.finditer(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", text, re.DOTALL)]
    more = [x for x in more if not any(a <= x[0] and x[2] <= b for a, _, b in pem)] + pem
    return base, [x for x in more if not any(a <= x[0] and x[2] <= b for a, _, b in base)]


def test_spans_ownership_and_mask_against_brute_force(spark):
    r = random.Random(8)
    marks = ["-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END OPENSSH PRIVATE KEY-----"]
    pool = ["".join(r.choice("aBcD3fG7hJ9+/_") for _ in range(r.randint(18, 30))) for _ in range(8)] + [f"{r.getrandbits(100):024x}" for _ in range(3)]
    bits = [*marks, *pool, "token = ", "passwd:", "git://me:pass-word!@host", "redis://:s3cr:et@h/x", "http://plain/x", "AKIA" + "Q7" * 8, " ", "\n", "é😀", "word", "x" * 30]
    rows = []
    for i in range(260):
        text = "".join(r.choice(bits) + r.choice(["", " ", "\n", "'"]) for _ in range(r.randint(0, 9))).replace("pass-word", f"pw{i // 3}")
        rows.append((r.choice([None, i, i, 7]), text, r.choice([None, "a", "b", "c", "d"]), r.choice(["en", "de", None])))
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    repo = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    owners, repos = {}, {}
    for _, text, source, lang in rows:
        base, more = brute_spans(text)
        for a, kind, b in base + more:
            m = re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", text[a:b]) if kind == "assign" else None
            value = m[1] if m else text[a:b]
            owners.setdefault(value, set()).add(source)
            repos.setdefault(value, set()).add((source, (source or "") + "/" + (lang or "")))
    want, masked = [], []
    order = ["assign", "access", "hex", "opaque", "url", "pem"]
    for i, text, source, lang in rows:
        base, more = brute_spans(text)
        spans = []
        for a, kind, b in base + more:
            m = re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", text[a:b]) if kind == "assign" else None
            value = m[1] if m else text[a:b]
            live = len(owners[value]) <= 2 and len(repos[value]) <= 4
            if live or order.index(kind) < 3:
                spans.append((a, order.index(kind), b, live))
        spans.sort()
        want.append((i, ",".join(f"{order[k]}:{a}:{b}" for a, k, b, _ in spans), sum(x[3] for x in spans), sum(not x[3] for x in spans)))
        out, at = "", 0
        for a, k, b, live in spans:
            if live and b > at:
                out, at = out + text[at:a] * (a > at) + f"[secret:{order[k]}]", b
        masked.append((i, out + text[at:], source, lang))
    got = [(x.doc_id, x.spans, x.n_live, x.n_copied) for x in secrets.find_secrets(docs, repository=repo).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, secrets.mask(docs, repository=repo).collect()))) == sorted(map(str, masked))
    assert {x.partition(":")[0] for _, spans, *_ in want for x in spans.split(",")} >= {"url", "pem", "opaque"}


def test_long_secrets_and_long_texts():
    user, password, label = "u" * 5000, "p!" * 5000, "VERY " * 40
    [(a, kind, b, value)] = secrets.more_spans(f"see ftp://{user}:{password}@host", [])
    assert (kind, value) == (4, password) and b - a == 10_000
    key = f"-----BEGIN {label}PRIVATE KEY-----\nabc\n-----END {label}PRIVATE KEY-----"
    assert secrets.more_spans("x " + key, []) == [(2, 5, 2 + len(key), key)]
    began = time.perf_counter()
    for part in ("-----BEGIN RSA PRIVATE KEY-----\n", "a://b:", "token    ", "A" * 50 + " "):
        secrets.more_spans(part * (2_000_000 // len(part)), secrets.base_spans(part * (2_000_000 // len(part))))
    many = key * 20_000
    assert len(secrets.more_spans(many, secrets.base_spans(many))) == 20_000
    assert time.perf_counter() - began < 30
