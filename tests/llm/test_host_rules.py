import re

from skysift.llm import host_rules


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ODD = [None, "", " \n\t\r\x0b\x0c ", "one", "a b c a b c", "a a a a a", "x\nx\n\n \nx", "é# ß| q", "<p>&&</p>", "w " * 20000, "one two three " * 30,
       "\r\nline\r\nline\r\n", " lead trail ", " ".join(f"w{i}" for i in range(60))]


def test_measures(documents, texts):
    rows = texts[:60] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_000, None)]
    got = host_rules.host_rules(documents(rows)).collect()
    assert sorted((r.doc.doc_id, *(r[m] for m in host_rules.MEASURES)) for r in got) == sorted((i, *plain(t)) for i, t in rows)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)


def hosts(spark):
    good = " ".join(f"word{i}" for i in range(80))
    bad = " ".join(f"word{i}#$" for i in range(80))
    short = "few words"
    rows = [(n, good, "fine.example") for n in range(40)] + [(100, bad, "fine.example")]
    rows += [(200 + n, bad, "spam.example") for n in range(40)] + [(290 + n, good, "spam.example") for n in range(6)]
    rows += [(300 + n, short, "stub.example") for n in range(60)] + [(390, good, "stub.example")]
    rows += [(400, bad, "new.example"), (500, good, None), (501, bad, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_words", host_rules.F.lit("mine"))


def test_hosts_weigh(spark, monkeypatch):
    want = None
    for most in (host_rules.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", most)
        kept = host_rules.passing(hosts(spark))
        assert kept.columns == ["doc_id", "text", "source", "n_words"]
        ids = {r.doc_id for r in kept.collect()}
        assert set(range(40)) | {100, 290, 500} <= ids  # a lone failure on a fine host, a clean page on a bad one
        assert not ids & set(range(200, 240)) and not ids & set(range(300, 391))  # notorious, blocked
        assert want is None or want == ids
        want = ids


def test_empty_table(documents):
    assert host_rules.host_rules(documents([])).count() == 0
