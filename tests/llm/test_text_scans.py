import hashlib
import random
import re
import time

import numpy as np
import pytest
from fixtures import ROWS, awkward, empty

from quillstream.llm import common
from quillstream.llm import line_dedup as L
from quillstream.llm import secret_scan as S
from quillstream.llm import winnow as W

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    lines = [(t or "").split("\n") for _, t in rows]
    key = lambda x: x.strip(SPACE).translate(FOLD)
    holders = {}
    for (i, _), ls in zip(rows, lines, strict=True):
        for x in ls:
            if len(key(x)) >= 20 and i is not None:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return [(i, len(ls), "\n".join(x for x in ls if key(x) not in gone or gone[key(x)] == i)) for (i, _), ls in zip(rows, lines, strict=True)]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"{'Éa' * (i % 3)}common LINE number {i:04d}" for i in range(12)] + ["short"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "  ", "\r"]) for _ in range(rng.randrange(6)))) for i in range(40)]
    rows += [(i, t) for i, t, *_ in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in L.op4_line_dedup(df).collect())
    want = sorted((i or -1, n, n - (len(k.split("\n")) if k or n == 1 else 0), hashlib.sha256(k.encode()).hexdigest()) for i, n, k in brute_lines(rows))
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert any(g[2] for g in got)


def test_line_dedup_where_few_keys_may_be_broadcast(spark, monkeypatch):
    """The most common lines are broadcast, the others joined; rows that repeat an id have other texts."""
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common, "MANY", 5)
    rng = random.Random(6)
    pool = [f"a line that is shared, number {i}" for i in range(40)]
    rows = [(i % 50 if i < 60 else None, "\n".join(rng.choice(pool[: rng.choice([2, 40])]) for _ in range(8))) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.line_dedup(df).collect()]
    want = [(i, k, n, n - (len(k.split("\n")) if k else 0)) for i, n, k in brute_lines(rows)]
    order = lambda x: (x[0] is not None, x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_line_dedup_is_linear_in_lines(spark):
    """Half of the lines of each text go, every other one."""
    took = []
    for n in (2_000, 100_000, 100_000):
        text = "\n".join(f"a common line with number {i}" if i % 2 else f"own line {i}" for i in range(n))
        df = spark.createDataFrame([(i, f"{text}\nend {i}") for i in range(3)], "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in L.line_dedup(df).collect()}
        took.append(time.time() - began)
        short = "\n".join(f"own line {i}" for i in range(0, n, 2))
        assert got == {0: (n + 1, n // 2, f"{short}\nend 0"), 1: (n + 1, n // 2, f"{short}\nend 1"), 2: (n + 1, 0, f"{text}\nend 2")}
    assert took[2] < 10


def test_line_dedup_awkward(spark):
    assert L.op4_line_dedup(awkward(spark)).count() == len(ROWS)
    assert L.op4_line_dedup(empty(spark)).collect() == []
    kept = L.line_dedup(awkward(spark), carry=("lang", "key"))
    assert {"lang", "key"} <= set(kept.columns) and kept.filter("key = 'x'").count() == len(ROWS)
    assert "Python" not in L.op4_line_dedup(awkward(spark))._jdf.queryExecution().toString()


ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    parts = ["password", "PassWd", "ſecret", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "\"", "'", "é", "🙂", "AKIA", "ABCDEFGHIJ1234", "0123456789abcdef", "deadbeef", "abc", "x.y/z+-_=1", "\n", "K"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        got = [s for s in S.scan(t.encode()) if s.kind < 3]
        assert [tuple(s) for s in got] == brute_spans(t), t


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('db_pwd = "Xk29fLq81mZp"', ["Xk29fLq81mZp"]),
        ('x = "Xk29fLq81mZp"\nAUTH_CREDENTIAL = x', ["Xk29fLq81mZp"]),
        ('client.private_key: Zq81xx-91kLmPq02', ["Zq81xx-91kLmPq02"]),
        ('key_pwd = "Xk29f" + "Lq81mZp3"', ["Xk29f", "Lq81mZp3"]),
        ("colour = 'Xk29fLq81mZp'", []),
        ("the passphrase: is a common word here", []),
        ('pwd = "aaaaaaaaaaaaaaaa"', []),
    ],
)
def test_lexer(text, found):
    data = text.encode()
    assert [data[s.start : s.end].decode() for s in sorted(S.lexed_spans(data))] == found


def test_secret_scan_rows(spark):
    got = S.op5_secret_scan(awkward(spark)).collect()
    assert len(got) == len(ROWS) and S.op5_secret_scan(empty(spark)).collect() == []
    r = next(r for r in got if r.doc_id is None)
    assert (r.n_assign, r.spans) == (1, "assign:21:42")
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


LONG_SECRET = "Xk29fLq81mZp" * 60


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"private_key = {LONG_SECRET}", [LONG_SECRET]),
        (f'private_key = "{LONG_SECRET}"', [LONG_SECRET]),
        (f'{"a" * 80}_private_key = "Xk29fLq81mZp"', ["Xk29fLq81mZp"]),
        ('bearer = "Xk29\\"fLq81mZp"', ['Xk29\\"fLq81mZp']),
        ("bearer = " + " + ".join(f'"Xk{i:02d}"' for i in range(20)), [f"Xk{i:02d}" for i in range(20)]),
        ('private_key: str = "Xk29fLq81mZp"', ["Xk29fLq81mZp"]),
        ('var authCredential string = "Xk29fLq81mZp"', ["Xk29fLq81mZp"]),
        ('export SIGNING_PWD="Xk29fLq81mZp"', ["Xk29fLq81mZp"]),
        ('String bearerAuth = "Xk29fLq81mZp"', ["Xk29fLq81mZp"]),
        ("private_key: Xk29fLq81mZp=", ["Xk29fLq81mZp="]),
        ('x = "abc"; private_key: Xk29fLq81mZp', ["Xk29fLq81mZp"]),
        ('pwd = base + "Xk29fLq81mZp"', ["Xk29fLq81mZp"]),
        ('pwd = "Xk29f" + salt + "Lq81mZp3"', ["Xk29f", "Lq81mZp3"]),
        ("auth_pwd = get_value9(name)", []),
        ("auth_pwd = config2[name]", []),
        ('auth_pwd = decode("Xk29fLq81mZp")', []),
        ('pwd = ("Xk29f"  # one\n  "Lq81mZp3")', ["Xk29f", "Lq81mZp3"]),
        ('pwd = "Xk29f" \\\n  "Lq81mZp3"', ["Xk29f", "Lq81mZp3"]),
        ('pwd = "Xk29f" +\n  "Lq81mZp3"', ["Xk29f", "Lq81mZp3"]),
        ('pwd = """Xk29f"Lq8\n1mZp3"""', ['Xk29f"Lq8\n1mZp3']),
        ("pwd = rb'Xk29fLq81mZp'", ["Xk29fLq81mZp"]),
        ("const pwd = `Xk29fLq81mZp`", ["Xk29fLq81mZp"]),
        ("a:\n  signing_pwd: |\n    Xk29fLq8\n\n    1mZpQ7\n  other: Xk29fLq81mZp", ["Xk29fLq8", "1mZpQ7"]),
        ("signing_pwd: >-\n  Xk29fLq81mZp", ["Xk29fLq81mZp"]),
        ('a = "Xk29fLq81mZp"\nb = a\na = other()\nbearer = b\npwd = a', ["Xk29fLq81mZp"]),
        (f'bearer = "{"Xk29fLq81mZp" * 90_000}"', ["Xk29fLq81mZp" * 90_000]),
    ],
)
def test_lexer_without_caps(text, found):
    data = text.encode()
    assert [data[s.start : s.end].decode() for s in sorted(S.lexed_spans(data))] == found


def test_partly_covered_literals_stay():
    spans = S.scan(b'private_key = "Zq!0123456789abcdef-Zq"')
    assert [(s.kind, s.start, s.end) for s in spans] == [(3, 15, 37), (2, 18, 34)]


def test_lexer_is_linear():
    start = time.process_time()
    for part in (b"a", b"a = ", b'"', b"\\", b"a: b ", b'a = "b" + ', b"a.b-", b"a b ", b"a[", b"a ", b"a = (", b'a = """', b"a: |\n b\n", b"a = b + ", b'"x" ', b"a = #\n"):
        S.lexed_spans(part * (200_000 // len(part)))
    assert time.process_time() - start < 6


def test_added_spans_find_what_was_put_there():
    """Recall and precision of added spans over generated source and configuration lines."""
    rng = random.Random(21)
    letters = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    value = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(14, 40))) + "7q"
    wanted, other = ("db_pwd", "bearerAuth", "AWS_ACCESS_KEY", "client.private_key", "signing-credential"), ("colour", "path", "comment", "sort_by", "page_id")
    forms = ('{n} = "{v}"', "{n}: {v}", "export {n}={v}", '"{n}": "{v}",', '{n} => \'{v}\'', '<add {n}="{v}"/>', "{n}: str = '{v}'", "{n}: |\n    {v}")
    lost = false = n = 0
    for _ in range(2000):
        lines, put = [], set()
        for _ in range(4):
            is_secret, v = rng.random() < 0.5, value()
            lines.append(rng.choice(forms).format(n=rng.choice(wanted if is_secret else other), v=v))
            if is_secret:
                put.add(v)
        text = "\n".join(lines)
        got = {text[s.start : s.end] for s in S.scan(text.encode()) if s.kind == 3}
        lost, false, n = lost + len(put - got), false + len(got - put), n + len(put)
    assert n > 3000 and lost <= 0.01 * n and false <= 0.01 * n


def test_spans_over_many_base_spans():
    base = [S.Span(i * 10, 0, i * 10 + 8) for i in range(50_000)]
    start = time.process_time()
    assert S.uncovered([S.Span(i * 10 + 1, 3, i * 10 + (7 if i % 2 else 9)) for i in range(50_000)], base) == [S.Span(i * 10 + 1, 3, i * 10 + 9) for i in range(0, 50_000, 2)]
    assert S.uncovered([S.Span(0, 3, 30)], [S.Span(0, 0, 10), S.Span(5, 1, 20), S.Span(20, 2, 30)]) == []
    assert time.process_time() - start < 3


def brute_winnow(t, k, w):
    """Positions of each window's minimum, rightmost of ties, by the same hash."""
    if not t:
        return []
    codes = np.array([ord(c) for c in t], dtype=np.uint32)
    h = [int(W.kgram_hashes(codes[i : i + k], k)[0]) >> 32 for i in range(max(1, len(t) - k + 1))]
    w = min(w, len(h))
    out = []
    for i in range(len(h) - w + 1):
        low = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == low)
        if not out or out[-1] != (low, at):
            out.append((low, at))
    return out


def test_winnow_against_brute_force():
    rng = random.Random(6)
    for k, w in ((5, 4), (16, 64), (3, 7), (1, 1)):
        for n in (0, 1, 2, 5, 40, 200):
            t = "".join(rng.choice("abé🙂") for _ in range(n))
            assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in W.winnow(t, k, w)] == brute_winnow(t, k, w)


def test_shared_runs_share_a_hash():
    rng = random.Random(8)
    for _ in range(50):
        run = "".join(rng.choice("abcdefgh ") for _ in range(W.K + W.W - 1))
        a, b = ("".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(200))) for _ in range(2))
        assert len(np.intersect1d(W.hashes(W.winnow(a + run + b)), W.hashes(W.winnow(b + run))))


def test_short_texts_that_keep_half_are_alike():
    rng = random.Random(9)
    for n in range(54, 158):
        a, b = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(n)) for _ in range(2))
        assert W.likeness(W.hashes(W.winnow(a)), W.hashes(W.winnow(W.edited(a, b)))) > 0, n


def jaccard(a, b):
    """Of the hashes (8 of each 16 digits) of two printed fingerprints."""
    x, y = ({p[i : i + 8] for i in range(0, len(p), 16)} for p in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_of_many_ranges(spark):
    """Very unequal texts over more ranges than rows of some; each row meets its successor."""
    rng = random.Random(4)
    rows = [(i * 7 - 300, "".join(rng.choice("abc ") for _ in range(20_000 if i == 40 else rng.randrange(60)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n in (1, 3, 60):
        got = {r.doc_id: (r.edited_sha256, r.fingerprint) for r in W.fingerprints(df, ranges=n).collect()}
        assert got == {i: (hashlib.sha256(W.edited(t, rows[(j + 1) % 150][1]).encode()).hexdigest(), W.as_text(W.winnow(t))) for j, (i, t) in enumerate(rows)}


def test_fingerprints_in_order_of_ids(spark):
    rows = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    got = W.fingerprints(awkward(spark), ranges=5).collect()
    assert len(got) == len(rows) and W.fingerprints(empty(spark)).collect() == []
    want = []
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        e = W.edited(t, following)
        own, other, after = (W.as_text(W.winnow(x)) for x in (t, e, following))
        want.append((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest(), own, other, jaccard(own, other), jaccard(own, after)))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)
    one = W.fingerprints(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_names_of_short_literals_are_not_weighed(monkeypatch):
    asked = []
    weigh = S.sensitivity
    monkeypatch.setattr(S, "sensitivity", lambda name: asked.append(name) or weigh(name))
    data = b'pwd = "short"\npin: 1234\nsigning_pwd = "Xk29fLq81mZp"\n' + b"a: b " * 1000
    assert [data[s.start : s.end] for s in S.lexed_spans(data)] == [b"Xk29fLq81mZp"] and asked == ["signing_pwd"]
