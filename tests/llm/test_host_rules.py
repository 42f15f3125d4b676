import math
import random
import re
from collections import Counter, defaultdict

from ledgerwind.llm import host_rules as hr

SCHEMA = "doc_id long, text string, source string, kept string, rules string"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(ch in "#*$%&|<>" for ch in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    c["base_failed"] = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    soft = (10 * c["n_symbols"] > len(words)) + (10 * c["n_dup_lines"] > 3 * len(lines)) + (not 2 * len(words) <= c["word_chars"] <= 15 * len(words))
    return c, soft


def brute(rows):
    done = [(r, *brute_counts(r[1])) for r in rows]
    hosts = defaultdict(lambda: [0, 0])
    for r, c, soft in done:
        hosts[r[2]][0] += 1
        hosts[r[2]][1] += c["base_failed"] or soft > 0
    n, bad = sum(h[0] for h in hosts.values()), sum(h[1] for h in hosts.values())
    mean = bad / n
    var = sum(k * (b / k) ** 2 for k, b in hosts.values()) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
    strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e4) if var > 0 else 1e4
    out = []
    for r, c, soft in done:
        k, b = hosts[r[2]]
        rate = (b + mean * strength) / (k + strength)
        allowed = 99 if rate <= 0 else -1 if rate >= 1 else max(-1, math.floor(math.log((1 - rate) / rate) / math.log(20)))
        out.append((r[0], *c.values(), not c["base_failed"] and soft <= allowed))
    return out


def make():
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(0, None, "a", "", ""), (1, "", None, "", ""), (2, " \n\t", "a", "", ""), (None, prose(80), "a", "", ""), (4, prose(60) + " x" * 100, "b", "", ""), (5, "a b c " * 30, "b", "", ""), (6, prose(60), None, "", "")]
    for i in range(10, 200):
        host = f"h{i % 5}"
        spam = rng.random() < (0.02, 0.1, 0.3, 0.8, 0.97)[i % 5]
        text = "\n".join(prose(12) for _ in range(8))
        if spam:
            text = rng.choice([text.replace(" ", " ### "), prose(9), "\n".join([prose(9)] * 9), text + "\n" + text])
        rows.append((i, text, host, "", ""))
    good = [(i, "\n".join(prose(12) for _ in range(8)) + (" #" * 12 if i == 500 else ""), "good", "", "") for i in range(300, 700)]
    return [*rows, *good, rows[9], (7000, prose(9000) + "\n" + "é" * 500, "h1", "", "")]


def test_matches_plain_python(spark):
    rows = make()
    got = sorted(map(str, hr.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))
    want = brute(rows)
    names = ["doc_id", *hr.COUNTS, "base_failed", "kept"]
    assert got == sorted("Row(" + ", ".join(f"{n}={v}" for n, v in zip(names, w, strict=True)) + ")" for w in want)
    by = {w[0]: w[-1] for w in want}
    assert by[500] and not by[501 - 501] and sum(by[i] for i in range(10, 200) if i % 5 == 4) == 0  # forgiven, failed, host rejected


def test_keep_good_returns_the_rows_that_judge_keeps(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = hr.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if dict((w[0], w[-1]) for w in brute(rows))[r.doc_id])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hr.judge(df).count() == 0 and hr.keep_good(df).count() == 0
