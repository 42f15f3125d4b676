import hashlib
import random

from ledgerwind.llm import chat_events as ce

BITS = ["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n\n", "\n<</SYS>>\n", "[ROLE] ", " [/ROLE]", "[/MSG]", "\\", "\\\\", "<", "</", "</s", "[", "a", "é", "\n", " ", "😀", "<\\s>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_render_and_parse_are_inverse():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "[INST]", "</s>"]), "".join(rng.choice(BITS) for _ in range(rng.randrange(7)))) for _ in range(rng.randrange(6))]
        formatted, spans = ce.render(turns)
        assert ce.parse(formatted) == turns
        assert [ce.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        for _, t in turns:
            assert not any(c in ce.escape(t) for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/MSG]"))


def test_rows_by_turn(spark):
    said = "</s>[INST] ok [/INST]"
    long = "".join(chr(97 + i % 26) for i in range(40_000))
    rows = [(1, 1, "assistant", long), (1, 0, "user", None), (-1, 0, "user", said), (-1, 1, "assistant", said), (2, 0, None, "x"), (2, None, "assistant", ""), (3, 5, "user", "same"), (3, 5, "user", "same"), (None, 1, "user", "lost")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message string").repartition(3)
    got = {r.conv_id: r for r in ce.read_back(ce.format_log(ce.from_turns(docs))).collect()}
    turns = {1: [("user", ""), ("assistant", long)], -1: [("user", said), ("assistant", said)], 2: [("assistant", ""), ("", "x")], 3: [("user", "same")] * 2, None: [("user", "lost")]}
    assert set(got) == set(turns)
    for conv, want in turns.items():
        learnt = "".join(t for r, t in want if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(want), sha("".join(f"{r}\n{t}\n" for r, t in want)))
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == (len(learnt), sha(learnt), len(ce.render(want)[0]))
    assert ce.read_back(ce.format_log(ce.from_turns(docs.limit(0)))).count() == 0


def test_edits_deltas_and_regenerations_fold(spark):
    log = [
        (1, 0, 10, "start", "user", "hi"), (1, 1, 11, "start", "assistant", None), (1, 2, 11, "delta", None, "he"), (1, 3, 11, "delta", None, "llo"),
        (1, 4, 12, "start", "user", "more"), (1, 5, 13, "start", "assistant", "old"), (1, 6, 11, "regenerate", None, None), (1, 7, 13, "delta", None, "lost"),
        (1, 8, 11, "delta", None, "new"), (1, 9, 10, "edit", None, "hey"), (2, 1, 20, "delta", None, "orphan"),
    ]
    df = spark.createDataFrame([(c, s, "", m, 0, k, r, t) for c, s, m, k, r, t in reversed(log)], "conv_id long, seq long, tie string, message long, part int, kind string, role string, text string")
    got = {r.conv_id: ce.parse(r.formatted) for r in ce.format_log(df).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "new")], 2: []}


def test_a_log_of_rows_holds_every_kind_of_event(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} " * (t * 40 + 1)) for c in range(20) for t in range(6)]
    rows += [(50, 1, "user", "one"), (50, 1, "user", "two"), (50, 1, "user", "two")]  # texts that share a turn
    log = ce.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(ce.F.count("*").alias("n")).collect()}
    assert set(kinds) == {"start", "delta", "edit", "regenerate"} and min(kinds.values()) > 20
    got = {r.conv_id: ce.parse(r.formatted) for r in ce.format_log(log.repartition(5)).collect()}
    for c in range(20):
        assert got[c] == [(role, text) for conv, _, role, text in rows if conv == c]
    assert sorted(got[50]) == [("user", "one"), ("user", "two"), ("user", "two")]
