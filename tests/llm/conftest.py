import re

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def vocabulary():
    """Path of a public vocabulary file."""
    public = pytest.importorskip("public_tokenizers")
    return public.path


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and odd texts."""
    return [
        None, "", " ", "\n", "\n\n", "a", "A  b\tc", "the same text twice", "the same text twice", "x" * 5000, "word " * 3000, "é É ñ ß ÿ Ÿ Σ ς İ",
        "<|endoftext|> a<|endoftext|>  b <|startoftext|>", "<|STARTOFTEXT|>", "tail  ", "   head", "a   b", "tab\t\tand\r\nline", "don't we'll I'd", "12 345 Ⅷ ½", "é combined", "　wide blank", "字符 文本", "😀😀 👍🏽", "\x00 nul \x1c fs \x7f",
    ]


@pytest.fixture(scope="session")
def lowered():
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lambda t: (t or "").translate(table)


@pytest.fixture(scope="session")
def words(lowered):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return lambda t: pattern.findall(lowered(t))
