"""Ids of pieces are those of whole texts, for every letter before every mark and for hostile mixtures."""

import json
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from levelforge.llm import tokens
from levelforge.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_path


def every_letter():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return [c for c, yes in zip(points, pc.match_substring_regex(pa.array(points), r"^\pL$").to_pylist(), strict=True) if yes]


@pytest.mark.parametrize("name", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_ids_are_those_of_whole_texts(name):
    rnd, own = random.Random(1), every_letter()
    texts = [f"a{c}{m} {c} {c}{c}b" for i, c in enumerate(own) for m in ".,;:!?"[i % 6]]
    texts += [f"{c}{m}" for c in "İक़ज़क़ज़שׁΣßŉǰΐ" for m in ".,;:!?"] + ["ज़, Kanalİ. x", "ΑΣ ΑΣ. Σ", "ß's don't WE'LL 12,5"]
    mixed = [rnd.choice(own) for _ in range(2000)] + [*"İक़ज़क़ज़שׁΣßŉǰΐ"] * 40 + [*" \n.,;:!?'s\x0b　̸́<|endoftext|>"] * 60
    texts += ["".join(rnd.choices(mixed, k=rnd.randint(1, 30))) for _ in range(20_000)]
    enc, whole = tokens.PieceEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert enc.form == {BYTE_TOKENIZER: "bytes", WORD_TOKENIZER: "lower"}[name]
    got = [ids[a:b].tolist() for _, ids, at in enc.encode(pa.array(texts), 7) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [[*e.ids, 7] for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_tokenizers_are_not_cut(tmp_path):
    spec = json.loads(Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER)).to_str())
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc, whole = tokens.PieceEncoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["one two. three", "", " x", None]
    got = [ids[a:b].tolist() for _, ids, at in enc.encode(pa.array(texts), 7) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert enc.form is None and got == [[*whole.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
