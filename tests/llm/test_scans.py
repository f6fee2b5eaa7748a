"""Plain spans of both scans against the patterns as the contracts state them, and what the methods add."""

import collections
import hashlib
import random
import re
import time

import pytest

from fieldgauge.llm import pii, secrets

PARTS = ["password", "Api_Key", "token", "secret", "=", ":", " ", '"', "'", "abc123DEF", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "deadbeef",
         "a@b.co", "x.y%z@", "mail-er.example", ".", "1.2.3.4", "256", "255.", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (555) 010-9999",
         "+49", "30 901820", "é", "𝒳", "\n", "\t", "-", "_", "/", "00", "7" * 14, "0" * 24, "and", "No"]


def texts(seed, n=250):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", None]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def brute_personal(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    forms = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)}
    return [(k, m.start(), m.end()) for k, (p, ok) in forms.items() for m in re.finditer(p, t) if ok(m[0])]


def check(rows, got, brute, kinds):
    for i, t in enumerate(rows):
        want = brute(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (t, line, got[i]["spans"])
        n = collections.Counter(k for k, _, _ in want)
        assert [got[i][f"n_{k}"] for k in kinds] == [n[k] for k in kinds]
        assert set(line.split(",")) <= set(got[i]["spans"].split(",")) | {""}


@pytest.mark.parametrize("seed", [1])
def test_plain_secrets_against_the_stated_patterns(spark, seed):
    rows = texts(seed)
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    check(rows, got, brute_secrets, ("assign", "access", "hex"))


@pytest.mark.parametrize("seed", [3])
def test_plain_personal_data_against_the_stated_patterns(spark, seed):
    rows = texts(seed)
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    check(rows, got, brute_personal, ("email", "ip", "card", "phone"))


def test_tokens_apart_from_plain_spans_against_all_pairs(spark):
    rows = texts(5, 300) + [" ".join(random.Random(6).choice(["12ab34", "1.2.3.4", "x" * 9, "ab-12-34", "4111 1111 1111 1111", "a1b2c3@d4.e5", "99999"]) for _ in range(1500))]
    for r in pii.scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect():
        plain = [(s["start"], s["end"]) for k in pii.KINDS for s in r[k]]
        tokens = [(s["start"], s["end"]) for s in r["token"]]
        assert not any(a < d and c < b for a, b in tokens for c, d in plain)
        text = rows[r["doc_id"]] or ""
        want = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            core = re.sub(r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "", m[0])
            a = m.start() + len(m[0]) - len(re.sub(r"^[^0-9A-Za-z]+", "", m[0]))
            b = a + len(core)
            if len(core) >= 5 and sum(c in "0123456789" for c in core) >= 2 and not any(a < d and c < b for c, d in plain):
                want.append((a, b))
        assert tokens == want


def test_spans_of_a_text_cost_in_proportion(spark):
    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"ab {100000 + 7 * i}" for i in range(n)))], "doc_id bigint, text string")
        start = time.perf_counter()
        assert len(pii.scanned(df).first()["token"]) == n
        return time.perf_counter() - start
    took(4000)
    assert min(took(16_000) for _ in range(2)) <= 2.2 * max(took(8_000) for _ in range(2))


def found(spark, rows):
    return {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


@pytest.mark.parametrize("serials", [[f"a{i:015}" for i in range(300)] + [f"lot 2024{i:04}b{i:07}" for i in range(300)],
                                     [f"deadbeef{490978 + 37 * i:08}" for i in range(600)], [f"rel-2024-{i:06}-customer{i % 9}backup" for i in range(600)]])
def test_serials_without_a_secret_are_left_alone(spark, serials):
    rows = [(i, f"see {s} here") for i, s in enumerate(serials)]
    got = sum("random" in s for s in found(spark, rows).values())
    assert got <= len(rows) // 10
    r = random.Random(1)
    keys = ["".join(r.choice(secrets.ALPHABETS["base62"]) for _ in range(44)) for _ in range(60)]
    mixed = found(spark, rows + [(10_000 + i, f"see {k} here") for i, k in enumerate(keys)])
    true = sum(mixed[10_000 + i] == f"random:4:48" for i in range(60))
    false = sum("random" in mixed[i] for i in range(len(rows)))
    assert true >= 0.9 * 60 and false <= secrets.MAX_FALSE * (true + false) + 1


def test_nothing_is_reported_without_power():
    assert not secrets.limits([(0, 20, False, 60, 45), (0, 20, False, 2, 5)])
    assert not secrets.limits([(0, 34, False, 2, 5), (5, 34, True, 2, 1000)])
    assert secrets.limits([(5, 40, False, 2, 50), (5, 40, True, 100, 1000)])


def test_secrets_ties_and_other_columns(spark):
    rows = [(1, "token=" + "0123456789abcdef" * 2, "x", 1), (2, "", "x", 2), (2, "", "x", 2)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_hex int"))
    assert got.count() == 3 and [r["spans"] for r in got.where("doc_id = 1").collect()] == ["assign:0:38,hex:6:38"]
    more = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_ip int"))
    assert more.count() == 3
