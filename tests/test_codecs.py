import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import codecs


@pytest.mark.parametrize("name", sorted(codecs.ENCODERS))
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"a", b"ab", b"\0\0\0\0", b"zz"]), max_size=900).map(b"".join)))
@settings(deadline=None, max_examples=60)
def test_round_trip(name, data):
    assert codecs.decode(codecs.ENCODERS[name](data), [name]) == (data, None)


def test_lzw_over_a_full_table():
    data = bytes(i * j % 251 for i in range(1, 200) for j in range(1, 200))
    assert codecs.lzw(codecs.to_lzw(data)) == data


def test_two_filters_in_order():
    data = b"some text, twice packed"
    assert codecs.decode(codecs.to_ascii_hex(codecs.ENCODERS["FlateDecode"](data)), ["ASCIIHexDecode", "FlateDecode"]) == (data, None)


def test_what_was_reached_comes_back_with_a_warning():
    data, warning = codecs.decode(b"68 65 79>", ["ASCIIHexDecode", "DCTDecode"])
    assert data == b"hey" and warning == "unsupported filter: DCTDecode"
    data, warning = codecs.decode(b"68 6x>", ["ASCIIHexDecode"])
    assert data == b"68 6x>" and "ASCIIHexDecode" in warning
    assert codecs.decode(b"not deflated", ["FlateDecode"])[1]


@pytest.mark.parametrize("data, out", [(b"4A4", b"J@"), (b"4a 4B\n>", b"JK"), (b"", b""), (b">", b"")])
def test_hex(data, out):
    assert codecs.ascii_hex(data) == out


@pytest.mark.parametrize("data, out", [(b"z", b"\0\0\0\0"), (b"<~87cUR~>", b"Hell"), (b"87cURD]i,\"Ebo80", b"Hello World!"), (b"", b"")])
def test_ascii85(data, out):
    assert codecs.ascii85(data) == out


@pytest.mark.parametrize("data", [b"ab{", b"a\x80", b"az"])
def test_ascii85_errors(data):
    with pytest.raises(codecs.DecodeError):
        codecs.ascii85(data)


@pytest.mark.parametrize("data, out", [(b"\x02abc\x80x", b"abc"), (b"\xfea\x80", b"aaa"), (b"\x00a", b"a"), (b"\x80", b"")])
def test_run_length(data, out):
    assert codecs.run_length(data) == out


@pytest.mark.parametrize("data", [b"\x05abc", b"\xfe"])
def test_run_length_errors(data):
    with pytest.raises(codecs.DecodeError):
        codecs.run_length(data)


@pytest.mark.parametrize("data, out", [(b"", False), (b"plain, text!\r\n\t", False), (b"\x0b", True), (b"\x00", True), ("é".encode(), True)])
def test_is_binary(data, out):
    assert codecs.is_binary(data) == out


def test_hex_dump():
    dump = codecs.hex_dump(bytes(range(65, 65 + 18)))
    assert dump.splitlines()[0] == "00000000  41 42 43 44 45 46 47 48  49 4a 4b 4c 4d 4e 4f 50  |ABCDEFGHIJKLMNOP|"
    assert dump.splitlines()[1].startswith("00000010  51 52 ") and dump.endswith("|QR|\n")
