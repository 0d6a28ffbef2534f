import itertools
import zlib

import numpy as np

from motiflake.llm import chat


def test_held_out_roles(spark):
    sf = "/root/testdata/sf0.1"
    role = {(r.conv_id, r.turn): r.role for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    found = chat.query(spark, sf).collect()
    assert sorted((r.conv_id, r.turn) for r in found) == sorted(role)
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.conv_id).encode()) % 3 == 1) for r in found)
    assert sum(r.role_pred == role[r.conv_id, r.turn] for r in out) / len(out) > 0.9


def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    return chat.fit(spark, rows)


def test_markers_give_turns(spark):
    text = "System: Be brief.\n\nUser: Hello there?\nstill me\nAssistant: Hi.\n### Human: and now\n**Assistant:** <|im_end|> done\n<|im_start|>user\nlast one<|im_end|>"
    (r,) = chat.parse(spark, spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string"), model(spark)).collect()
    assert r.rendered == "".join(
        f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in [("system", "Be brief."), ("user", "Hello there?\nstill me"), ("assistant", "Hi."), ("user", "and now"), ("assistant", "< |im_end|> done"), ("user", "last one")]
    ) and r.n_turns == 6


def test_odd_rows(spark, tmp_path):
    rows = [(1, 0, None, "user"), (1, 1, "", None), (1, None, "hello", "USER"), (None, 0, "no conversation", "x"), (2, 0, "word " * 50_000, "user"), (2, 0, "word " * 50_000, "user"), (3, 5, "User:", "user")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, text string, role string, piece int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = chat.query(spark, str(tmp_path)).collect()
    assert len(found) == 7 and {(r.conv_id, r.turn) for r in found if r.role_pred is None} == {(1, 0), (1, 1)}
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert chat.query(spark, f"{tmp_path}/none").collect() == []


def test_a_conversation_over_many_pieces_is_labelled_as_a_whole(spark):
    rng = np.random.default_rng(0)
    m = model(spark)
    rows = [(7, t, "x" * int(rng.integers(1, 1500))) for t in range(900)] + [(c, t, "y" * int(rng.integers(1, 900))) for c in range(40) for t in range(6) if c != 7]
    got = {(r.conv_id, r.turn): r.role_pred for r in chat.parse(spark, spark.createDataFrame(rows, "conv_id long, turn long, text string"), m).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == conv)
        v, back = None, []
        for r in mine:
            v = chat._forward(m, v, m.scores(r[2])[1], back)
        state, path = int(v.argmax()), []
        for before, inside in reversed(back):
            path.append(state)
            if before is not None:
                state = int((before + (m.line if inside else m.turn)[:, state]).argmax())
        assert [got[r[0], r[1]] for r in mine] == [chat.ROLES[s] for s in reversed(path)]


def line_scores(m, text):
    """Scores of each line by state, from the model's tables and features found anew."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    out = []
    for i, x in enumerate(lines):
        marked = [r for r in chat.ROLES if x.lower().startswith(r + ": ")]
        body = x.split(": ", 1)[1] if marked else x
        bodies = [y.split(": ", 1)[1] if any(y.lower().startswith(r + ": ") for r in chat.ROLES) else y for y in lines]
        features = [("length", len(body).bit_length()), ("end", {"?": 2, ".": 1, "!": 1}.get(body.strip()[-1:], 0))]
        if i == 0:
            features += [("rows", min(len(lines), 12)), ("size", int(2 * np.log2(sum(map(len, bodies)) + 1)))]
        s = [sum(int(m.emit[f][k] if f in m.emit else m.unseen[f[0]][k]) for f in features) for k in range(3)]
        for r in marked:
            s = [v + round(1000 * (-1.0 if chat.ROLES[k] == r else -40.0)) for k, v in enumerate(s)]
        out.append(s)
    return out


def test_short_conversations_take_the_best_of_all_paths(spark):
    m, rng = model(spark), np.random.default_rng(3)
    words = ["What is it?", "It is so.", "and then", "user: hello there", "Assistant: Yes!", "System: Be brief.", "x" * 300, "Why?" * 40]
    rows = [(c, t, "\n".join(rng.choice(words, int(rng.integers(1, 3))))) for c in range(40) for t in range(int(rng.integers(1, 5)))]
    found = {(r.conv_id, r.turn): r for r in chat.parse(spark, spark.createDataFrame(rows, "conv_id long, turn long, text string"), m).collect()}
    checked = 0
    for c in range(40):
        mine = [r for r in rows if r[0] == c]
        scores = [line_scores(m, r[2]) for r in mine]
        first = [k == 0 for s in scores for k in range(len(s))]
        flat = [x for s in scores for x in s]

        def value(path):
            moves = sum(int((m.turn if new else m.line)[a, b]) for (a, b), new in zip(itertools.pairwise(path), first[1:], strict=True))
            return int(m.start[path[0]]) + moves + sum(s[p] for s, p in zip(flat, path, strict=True))

        ranked = sorted(itertools.product(range(3), repeat=len(flat)), key=value, reverse=True)
        if len(ranked) > 1 and value(ranked[0]) == value(ranked[1]):
            continue
        checked += 1
        at = 0
        for r, s in zip(mine, scores, strict=True):
            roles = [chat.ROLES[p] for p in ranked[0][at : at + len(s)]]
            at += len(s)
            got = found[r[0], r[1]]
            assert [x.split("\n", 1)[0] for x in got.rendered.split("<|im_start|>")[1:]] == [g for g, _ in itertools.groupby(roles)] and got.n_turns == len(list(itertools.groupby(roles)))
    assert checked > 30


def test_rows_that_repeat_are_so_many_turns(spark):
    rows = [(1, 0, "What is it?")] * 5 + [(1, 1, "It is so.")] * 2 + [(None, None, "x")] * 3000
    found = chat.parse(spark, spark.createDataFrame(rows, "conv_id long, turn long, text string"), model(spark)).collect()
    assert sorted((str(r.conv_id), str(r.turn)) for r in found) == sorted((str(a), str(b)) for a, b, _ in rows)
