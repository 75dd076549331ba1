import random

from postlane.llm import preferences

TURNS = "array<struct<role:string,text:string>>"


def show(turns):
    return "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def mask(turns):
        at, spans = 0, []
        for turn in turns:
            whole = show([turn])
            if turn[0] == "assistant":
                spans.append(f"{at + whole.index(chr(10)) + 1}:{at + len(whole) - 1}")
            at += len(whole)
        return ",".join(spans)

    a, b = chosen[n:], rejected[n:]
    return n, show(chosen[:n]), show(a), show(b), mask(a), mask(b)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    turn = lambda: (rnd.choice(["user", "assistant", "system", None, ""]), rnd.choice(["é a", "b<|im_end|>", "", None, "c\nd"]))
    pairs = []
    for i in range(200):
        shared = [turn() for _ in range(rnd.randrange(0, 4))]
        pairs.append((i, shared + [turn() for _ in range(rnd.randrange(0, 4))], shared + [turn() for _ in range(rnd.randrange(0, 4))]))
    df = spark.createDataFrame(pairs, f"pair int, chosen {TURNS}, rejected {TURNS}")
    rows = {r["pair"]: r for r in preferences.format_preferences(df).collect()}
    for i, chosen, rejected in pairs:
        r = rows[i]
        got = r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], r["chosen_mask"], r["rejected_mask"]
        assert got == brute(chosen, rejected)


def test_masks_cover_the_answers_and_their_end(spark):
    chosen = [("user", "Hi"), ("assistant", "Hello"), ("user", "Why?"), ("assistant", "So.")]
    rejected = [("user", "Hi"), ("assistant", "Go away")]
    df = spark.createDataFrame([(chosen, rejected)], f"chosen {TURNS}, rejected {TURNS}")
    r = preferences.format_preferences(df).first()
    spans = [tuple(map(int, s.split(":"))) for s in r["chosen_mask"].split(",")]
    assert [r["chosen"][a:b] for a, b in spans] == ["Hello<|im_end|>", "So.<|im_end|>"]
    assert r["prompt"] == show(chosen[:1]) and r["n_prompt_turns"] == 1


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "left over"),
        (2, 0, "user", "no answer"),
        (None, 0, "user", "a"), (None, 1, "assistant", None),
        (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "assistant", "b"), (3, 0, "assistant", "b"),
        (4, 5, None, "x" * 200_000), (4, 6, "assistant", "b"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn int, role string, text string, prompt int, _last int")
    out = {r["conv_id"]: r for r in preferences.format_preferences(preferences.answer_pairs(df)).collect()}
    assert set(out) == {None, 1, 3, 4}
    assert [out[k]["rejected_conv"] for k in (None, 1, 3, 4)] == [1, 3, 4, None]
    assert out[1]["chosen"] == out[1]["rejected"] == out[1]["chosen_mask"] == ""  # equal answers
    assert out[1]["n_prompt_turns"] == 2
    assert out[None]["chosen"] == show([("assistant", None)]) and out[None]["n_prompt_turns"] == 1
    assert len(out[4]["prompt"]) > 200_000
    empty = df.limit(0)
    assert preferences.format_preferences(preferences.answer_pairs(empty)).count() == 0


def test_null_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, None, [("assistant", "a")]), (2, [], [])], f"extra int, chosen {TURNS}, rejected {TURNS}")
    rows = {r["extra"]: r for r in preferences.format_preferences(df).collect()}
    assert rows[1]["chosen"] == "" and rows[1]["rejected"] == show([("assistant", "a")])
    assert rows[2]["prompt"] == rows[2]["chosen"] == rows[2]["rejected_mask"] == ""


def test_branches_have_prompts_and_completions_of_any_length(spark):
    rnd = random.Random(7)
    talks = {}
    for conv in range(60):
        turns = [("user" if i % 2 == 0 else "assistant", rnd.choice(["yes", "no", f"t{conv}{i}"])) for i in range(rnd.randrange(1, 9))]
        talks[conv] = turns if conv % 10 else [("user", text) for _, text in turns]
    talks[None] = [("user", "a"), ("assistant", "yes")]
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    pairs = preferences.branch_pairs(df)
    order = [None, *range(60)]
    seen = set()
    for p in pairs.collect():
        chosen, rejected = ([tuple(t) for t in p[c]] for c in ("chosen", "rejected"))
        following = order[(order.index(p["conv_id"]) + 1) % len(order)]
        assert p["rejected_conv"] == following and chosen == talks[p["conv_id"]]
        answers = [i for i, (role, _) in enumerate(chosen) if role == "assistant"]
        assert any(rejected == chosen[:b] + talks[following][b:] for b in answers or [len(chosen)])
        seen.add(p["conv_id"])
    assert seen == set(talks)
    formatted = {r["conv_id"]: r for r in preferences.format_preferences(pairs).collect()}
    for p in pairs.collect():
        r = formatted[p["conv_id"]]
        got = r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], r["chosen_mask"], r["rejected_mask"]
        assert got == brute(*([tuple(t) for t in p[c]] for c in ("chosen", "rejected")))
    assert len({r["n_prompt_turns"] for r in formatted.values()}) > 3
    assert any(r["rejected_mask"].count(",") for r in formatted.values())
    assert preferences.branch_pairs(df.limit(0)).count() == 0
