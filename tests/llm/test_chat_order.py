"""Blocks with too many rows are cut in order, so that replies stay behind the turns they answer."""

from tessella.llm import chat


def test_full_blocks_are_cut_in_order(spark):
    said = [(c, t, s, f"{s} {t}") for c in (1, None) for t in range(200) for s in ("amy", "bob", "cid")]
    said += [(2, None, "amy", f"{i:04}") for i in range(1100)] + [(3, t, "amy", "x") for t in range(5)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(7)
    got = chat.rotate(turns).collect()
    for c in {r[0] for r in said}:
        mine = sorted((r for r in got if r.conv_id == c and r.speaker == "amy"), key=lambda r: (r.block, r.part))
        want = [(t, s, b) for d, t, s, b in said if d == c]  # listed in order
        assert [r.n_turns for r in mine] == [min(512, len(want) - k) for k in range(0, len(want), 512)]
        assert [r.part for r in mine] == list(range(len(mine)))
        text = "".join(f"<|im_start|>{'assistant' if s == 'amy' else 'user name=' + s}\n{b}<|im_end|>\n" for _, s, b in want)
        assert "".join(r.text for r in mine) == text
