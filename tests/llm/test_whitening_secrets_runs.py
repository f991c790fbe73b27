import hashlib
import random

import brute
import numpy as np
import pytest

from analystry.llm import runs, secrets, whitening

STRANGE = [(None, "no id"), (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (5, "ünïcödé ​ 漢字 🙂" * 50)]
BITS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " = ", '"', "'", " ", "\n", "\n\n", "\n \t\n", "AKIA", "AKIAQWERTYUIOPASDF", "abcdef0123456789", "0" * 20,
        "hunter2x9", "Zx81-longer_value.9", "user", "login: anna", "client_id=appl1", "pwd:a1b2c3", "pass = ", "https://db.example.com/x", "jdbc:mysql://h", "ß漢🙂", "word " * 60, "x" * 390]


def texts(seed, count):
    draw = random.Random(seed)
    return [(100 + k, "".join(draw.choice(BITS) for _ in range(draw.randint(1, 60)))) for k in range(count)]


def test_secrets_agree_with_plain_patterns_and_all_pairs(documents):
    rows = STRANGE + texts(3, 500) + [(900, "secret=" * 20_000), (901, "AKIA" * 30_000), (902, "0" * 100_000), (903, "password: token: abcdefghijklmnop")]
    got = secrets.find_secrets(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    want, added = sorted((str(i), *brute.secrets(t)) for i, t in rows), 0
    assert sorted((str(r["doc_id"]), (r["n_assign"], r["n_access"], r["n_hex"]), r["base_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        if i and 100 <= i < 900:
            spans = [s.split(":") for s in by_id[i]["spans"].split(",") if s]
            weak = {(k, int(a), int(b)) for k, a, b in spans if k not in ("assign", "access", "hex")}
            assert weak == brute.credential_parts(t, secrets.KINDS), t
            assert spans == sorted(spans, key=lambda s: (int(s[1]), [k[0] for k in secrets.KINDS].index(s[0])))
            assert by_id[i]["n_added"] == len(weak)
            added += len(weak)
    assert added > 200 and secrets.find_secrets(documents([])).count() == 0


def test_weak_parts_need_each_other(documents):
    pair = "login: anna7 ... pwd: a1b2c3d4"
    rows = [(1, pair), (2, "login: anna7 alone"), (3, "pwd: a1b2c3d4 alone"), (4, pair.replace("...", "\n\n")), (5, pair.replace("...", "." * 500)), (6, "see https://a.example/ there"),
            (7, "https://a.example/ with pwd=a1b2c3d4")]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(documents(rows)).collect()}
    assert got == {1: "identifier:0:12,secret:17:30", 2: "", 3: "", 4: "", 5: "", 6: "", 7: "endpoint:0:18,secret:24:36"}


def test_many_parts_in_one_scope_are_not_paired(documents):
    got = secrets.find_secrets(documents([(1, "login: anna7 pwd: a1b2c3d4 " * 4000)])).first()
    assert got["n_added"] == 8000


def periodic(seed):
    draw = random.Random(seed)
    words = [draw.choice("abcdefghijklmnopqrstuvwxyz"[:draw.choice([1, 2, 3, 5, 26])]) for _ in range(draw.randint(0, 260))]
    for _ in range(draw.randint(0, 3)):
        if len(words) > 30:
            a = draw.randrange(len(words))
            p, b = draw.randint(1, max(1, (len(words) - a) // 3)), draw.randint(a, len(words))
            for i in range(a, b):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs_agree_with_every_lag(documents):
    rows = STRANGE + [(100 + k, random.Random(k).choice([" ", "\n", "\t  "]).join(periodic(k))) for k in range(300)]
    rows += [(500, "na " * 5000), (501, "é 漢 🙂 " * 40), (502, "tick tock " * 30)]
    got = runs.periodic_runs(documents(rows, extra=True), texts=True).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        want = [(0, 5000, 1)] if i == 500 else brute.periodic_runs(words)
        assert [tuple(r) for r in by_id[i]["runs"]] == want and by_id[i]["n_words"] == len(words)
        gone = {k for start, length, period in want for k in range(start + period, start + length)}
        collapsed = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert by_id[i]["collapsed"] == collapsed and by_id[i]["collapsed_sha256"] == hashlib.sha256(collapsed.encode()).hexdigest()
    assert sum(len(r["runs"]) for r in got) > 50 and runs.periodic_runs(documents([])).count() == 0
    left = {r["doc_id"]: r for r in runs.without_runs(documents(rows, extra=True)).collect()}
    assert left[1]["text"] is None and left[3]["text"] == "   \n\t " and left[500]["text"] == "na" and left[4]["text"] == "one two"


def test_splitting_and_slices_change_nothing(monkeypatch):
    data = [" ".join(periodic(k)).encode() for k in range(60)]
    whole = runs.Slice(data)
    monkeypatch.setattr(runs, "LEAST_DROP", 1.0)
    assert runs.Slice(data).runs == whole.runs
    monkeypatch.setattr(runs, "SLICE_BYTES", 200)
    parts = list(runs.slices(data))
    assert len(parts) > 5 and [r for p in parts for r in runs.Slice(p).runs] == whole.runs


def test_long_runs_take_linear_work():
    assert runs.Slice([b"a " * 300_000]).runs == [[(0, 300_000, 1)]]
    short, long = "a ", "a b "
    while len(long) < 200_000:
        short, long = long, long + short
    assert len(runs.Slice([long.encode()]).runs[0]) > 1000


def test_periodic_words_of_chosen_documents(spark, documents):
    import zlib

    from analystry.llm.queries import with_planted_runs

    rows = STRANGE + [(k, " ".join(f"w{k}_{j}" for j in range(k % 70))) for k in range(100, 400)]
    for r in with_planted_runs(documents(rows)).collect():
        words = [w.decode() for w in (dict((i, t) for i, t in rows)[r["doc_id"]] or "").encode().split()]
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        assert (r["text"] or "").encode().split() == [w.encode() for w in words]


def vectors(spark, rows, extra=False):
    return spark.createDataFrame([(*r, "x", 3) if extra else r for r in rows], "vec_id long, embedding array<float>" + (", component string, n int" if extra else ""))


@pytest.mark.parametrize("seed, n, d", [(0, 300, 40), (1, 30, 64), (2, 200, 3), (3, 9, 24)])
def test_whitening_agrees_with_dense_decomposition(spark, seed, n, d):
    draw = np.random.default_rng(seed)
    data = (draw.normal(size=(n, d)) * np.linspace(2, 0.4, d)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(0, data[0].tolist()), (None, data[1].tolist())]
    odd = [(900, None), (901, []), (902, [float("nan")] * d), (903, [None] + [1.0] * (d - 1)), (904, [1.0] * (d + 1)), (905, [float("inf")] * d)]
    got = whitening.whitened_rows(vectors(spark, rows + odd, extra=True)).collect()
    x = np.floor(256 * data.astype(float)).astype(np.int64)
    u = np.unique(x, axis=0)
    z = u - u.mean(axis=0)
    v = z.T @ z / len(u)
    values, axes = np.linalg.eigh(v)
    k = min(4, d, int((values > 1e-9 * values.sum()).sum()))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = (x - u.mean(axis=0)) @ axes / np.sqrt(values)
    assert len(got) == k * len(rows) and {r["n"] for r in got} == {len(u)}
    for j in range(k):
        part = {r["vec_id"]: r for r in got if r["component"] == j + 1}
        have = np.array([part[i]["whitened"] for i in range(n)])
        assert np.allclose(have * np.sign(have @ white[:, j]), white[:, j], atol=1e-9)
        assert part[0]["explained"] == pytest.approx(values[j] / np.trace(v), rel=1e-10) and part[0]["identity_error"] < 1e-10
    sums = [int(s) for s in u.sum(axis=0)]
    assert {r["vec_id"]: r["deviation"] for r in got if r["vec_id"] is not None} == {i: sum((len(u) * int(a) - s) ** 2 for a, s in zip(x[i], sums)) for i in range(n)}


def test_whitening_without_spread_and_with_ties(spark):
    assert whitening.whitened_rows(vectors(spark, [])).count() == 0
    assert whitening.whitened_rows(vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    tied = whitening.whitened_rows(vectors(spark, [(k, [float(a == k) for a in range(6)]) for k in range(6)])).collect()
    assert {r["component"] for r in tied} == {1, 2, 3, 4} and tied[0]["identity_error"] < 1e-12
    huge = whitening.whitened_rows(vectors(spark, [(k, [1e30 * k, float(k * k)]) for k in range(5)])).collect()
    assert len({r["component"] for r in huge}) >= 1


def test_whitening_grows_the_subspace_where_it_stalls(spark, monkeypatch):
    monkeypatch.setattr(whitening, "COLUMNS", 8)
    draw = np.random.default_rng(5)
    data = draw.normal(size=(400, 48)).astype(np.float32)
    fit = whitening.fit_whitening(vectors(spark, [(k, v.tolist()) for k, v in enumerate(data)]).select(whitening.scaled(whitening.F.col("embedding")).alias("x")))
    x = np.floor(256 * data.astype(float))
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    assert np.allclose(fit.values, values, rtol=1e-10) and fit.residual < 1e-9
