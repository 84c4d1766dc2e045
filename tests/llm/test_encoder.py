"""Token ids of texts by either library, whole or word by word."""

import public_tokenizers
from tokenizers import Tokenizer

from sluiceway.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LATIN = ["", " ", "one two  three", "it's 12\n\n three\tfour \n", "élan São ɏ", " lead and trail ", "x" * 300, "a\n \nb c\r\n d", "don't   we'll 3.14 #$%"]
OTHER = ["слово и слово", "你好 世界 one two", "a 　 b", "mixed слово two слово"]


def test_latin_texts_go_whole_and_give_the_files_ids():
    encoder = packing.Encoder(PATH)
    plain = Tokenizer.from_file(PATH)
    texts = LATIN + OTHER
    width = {"H": 2, "I": 4}[encoder.code]
    got = [[int.from_bytes(raw[k : k + width], "little") for k in range(0, len(raw), width)] for raw in encoder(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]
    # No Latin word was cut out and kept; a table of them costs more than encoding whole texts.
    assert encoder.fast is not None and {"two", "three", "we'll"}.isdisjoint(set(encoder.words) - {w for t in OTHER for w in t.split(" ")})
    assert "слово" in encoder.words and set(encoder.words) <= {w for t in OTHER for w in t.split(" ")}
