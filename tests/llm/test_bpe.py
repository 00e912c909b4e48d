import random

import public_tokenizers
from tokenizers import Tokenizer

from fareloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def samples():
    rng = random.Random(5)
    alphabets = ["abcdefgh  '\n", "äöüßéèç einen ", "日本語 テスト", " \t\n\r  \x1c\x85", "0123.,;!?#*", "🙂👍🏽é́ ‍", "<|endoftext|> a"]
    texts = ["", " ", "Don't we'll they've I'm it's", "a<|endoftext|>b  <|endoftext|>", "x" * 5000, "  \n\n  end", "ab" * 40000]
    for _ in range(300):
        chars = "".join(rng.sample(alphabets, 3))
        texts.append("".join(rng.choice(chars) for _ in range(rng.randrange(60))))
    return texts + [chr(c) * 2 + " " + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]


def test_ids_and_texts_equal_the_library(spark):
    texts = [*samples(), None]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, (text, ids) in enumerate(zip(texts, want)):
        got = [int.from_bytes(rows[i].ids[k:k + 4], "little") for k in range(0, len(rows[i].ids), 4)]
        assert got == ids, text
        assert rows[i].text == library.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).collect() == []
