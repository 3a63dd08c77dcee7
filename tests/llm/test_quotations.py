"""Quotation links against brute force: whole passages first, then all owners of a line."""

from __future__ import annotations

import random

from corvane.llm import queries, quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(texts: list[str]) -> list[tuple[int, int | None]]:
    """(n_linked, reply_to) of the messages of one conversation, by turn."""
    out, owned = [], []
    for text in texts:
        quoted, own = quotations.parse(text)
        best, reply = {}, {}
        for passage in {p for p, _, _ in quoted}:
            lines = [(level, x) for p, level, x in quoted if p == passage and x]
            text = [x for _, x in lines]
            whole = [m for m, have in enumerate(owned) if any(have[i : i + len(text)] == text for i in range(len(have)))] if text else []
            n = [sum(x in have for x in text) for have in owned]
            if whole:
                best[passage] = (len(text), whole[-1])
            elif any(n):
                best[passage] = max((k, m) for m, k in enumerate(n))
            if passage in best:
                if lines[0][0] == 1:
                    reply[passage] = best[passage]
        out.append((len(best), max(reply.values())[1] if reply else None))
        owned.append([x for x in map(quotations.normal, own.split("\n")) if x])
    return out


def test_most_lines_decide_among_all_owners(spark, tmp_path):
    """Greetings recur, so that the latest owner of most lines is seldom the message that was quoted."""
    first = ["hi\nthe meeting is at 3\nthanks", "hi\nthanks", "> hi\n> the meeting is at 3\n> thanks\nok"]
    assert brute(first)[2] == (1, 0)
    apart = ["a\nb\nc", "a\nx\nb\nc", "> a\n> b\n> c", "> a\n> c"]  # the second has all lines too, but not in a row
    assert [x[1] for x in brute(apart)] == [None, None, 0, 1]
    rng, talks = random.Random(5), [first, apart]
    for _ in range(8):
        said: list[str] = []
        for _ in range(25):
            lines = ["hi", *(f"line {rng.randrange(12)}" for _ in range(rng.randint(1, 4))), "thanks"]
            for _ in range(rng.randint(0, 2) if said else 0):
                old = quotations.parse(rng.choice(said))[1].split("\n")
                lines = [rng.choice(["> ", "> > "]) + x for x in old] + ["so", *lines]
            said.append("\n".join(lines))
        talks.append(said)
    rows = [(c, t, "user", x) for c, said in enumerate(talks) for t, x in enumerate(said)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in queries.op7_quotations(spark, str(tmp_path)).collect()}
    assert got == {(c, t): x for c, said in enumerate(talks) for t, x in enumerate(brute(said))}
    assert sum(x[1] is not None for x in got.values()) > 40
