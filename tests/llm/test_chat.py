import hashlib
import random
from collections import defaultdict

from glyphstream.llm import chat, queries


def key(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def hold(rows, windows):
    convs, own = defaultdict(list), defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    for w in windows:
        own[w.conv_id].append(w)
    for conv, turns in convs.items():
        turns.sort(key=key)
        got, loss = [], ""
        for w in sorted(own[conv], key=lambda w: (w.block, w.window)):
            parts = [p.removeprefix("[turn ") for p in w.text.split("[/turn]")[:-1]]
            plain = lambda s: s.replace("\\c", "]").replace("\\o", "[").replace("\\b", "\\")
            shown = [(plain(p.partition("]")[0]), plain(p.partition("]")[2])) for p in parts]
            got += shown[w.n_repeated :]
            loss += "".join(plain(w.text[s.start : s.end]) for s in w.loss_spans)
        assert got == [(r[2] or "", r[3] or "") for r in turns]
        assert loss == "".join(r[3] or "" for r in turns if r[2] == "assistant")


def test_windows_and_masks(spark):
    rng = random.Random(2)
    rows = [(1, None, None, None), (1, 0, "user", "a\\o[b]\\[/turn]"), (None, 3, "assistant", "no conversation"), (2, 0, "user", ""), (2, 0, "user", ""), (2, 0, "assistant", "tie")]
    rows += [(3, i, "system" if i == 0 else ("user", "assistant")[i % 2], " ".join(["é🙂w"] * rng.randint(0, 30))) for i in range(90)]
    rows += [(7, i, role, text) for i, role in enumerate(["us]er", "[/turn]", "\\c", "a\\o]", "[turn user]"]) for text in ("hi", "]", "[/turn][turn x]", "\\b\\c")]
    rows += [(8, None, "user", f"no turn {i % 50}") for i in range(60)] + [(8, 5, "assistant", "same turn " * (i % 3)) for i in range(60)]
    rows += [(9, 0, "system", "w " * 97), (9, 1, "user", "short"), (9, 2, "assistant", "v " * 85), (9, 3, "user", "u " * 97), (9, 4, "assistant", "x " * 60), (9, 5, "user", "y")]
    rows += [(4, i, ("user", "assistant")[i % 2], "long " * (200 if i == 3 else 5)) for i in range(12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(3)
    out = chat.windows(df, budget=100, history=30, block=16).collect()
    hold(rows, out)
    three = sorted((w for w in out if w.conv_id == 3), key=lambda w: (w.block, w.window))
    assert len(three) > 6 and all(w.text.startswith("[turn system]") for w in three)
    assert sum(w.n_repeated > 1 for w in three) > 3
    alone = lambda w: w.n_repeated == 0 and w.text.count("[/turn]") == 1
    assert all(w.n_tokens <= 100 or alone(w) for w in out) and sum(w.n_tokens > 100 for w in out) == 1
    assert all(w.text.count("[/turn]") - w.n_repeated <= 16 for w in out)
    assert len({w.block for w in out if w.conv_id == 8}) == 8
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    got = {r.conv_id: r for r in queries.op9_chat_windows(spark, sf).collect()}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort(key=key)
        text = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
