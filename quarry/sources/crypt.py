"""The standard security handler: RC4 and AES, user or owner password."""

from __future__ import annotations

from functools import cache
from hashlib import md5, sha256, sha384, sha512
from itertools import cycle

from .objects import Name, Stream, Text

# Fixed value: the padding string of the public specification.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")
# Names of permission bits, from bit 2 of /P on (0-based).
PERMISSIONS = {
    "Print": 2, "Modify": 3, "Copy/extract text": 4, "Annotate": 5, "Fill forms": 8, "Accessibility extract": 9, "Assemble": 10, "Print high quality": 11,
}


class WrongPassword(ValueError):
    pass


@cache
def _library_rc4():
    """RC4 of the library that Python's hashes are linked with; None where it lacks it or doesn't give a known result."""
    try:
        import _hashlib
        import ctypes

        held = ctypes.CDLL(_hashlib.__file__)
        begin, run = held.RC4_set_key, held.RC4
    except (ImportError, AttributeError, OSError):
        return None
    begin.argtypes, begin.restype = (ctypes.c_void_p, ctypes.c_int, ctypes.c_char_p), None
    run.argtypes, run.restype = (ctypes.c_void_p, ctypes.c_size_t, ctypes.c_char_p, ctypes.c_void_p), None

    def found(key: bytes, data: bytes) -> bytes:
        state, out = ctypes.create_string_buffer(4096), ctypes.create_string_buffer(len(data) + 1)
        begin(state, len(key), bytes(key))
        run(state, len(data), bytes(data), out)
        return out.raw[:-1]

    # A known example.
    return found if found(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" else None


def rc4(key: bytes, data: bytes) -> bytes:
    found = _library_rc4()
    return plain_rc4(key, data) if found is None else found(key, data)


_ROUND = [*range(1, 256), 0]


def plain_rc4(key: bytes, data: bytes) -> bytes:
    """RC4 without a library."""
    s, j = list(range(256)), 0
    for i, k in zip(range(256), cycle(key)):
        a = s[i]
        j = (j + a + k) & 255
        s[i] = s[j]
        s[j] = a
    j, n, out = 0, len(data), []
    # The key's bytes first, a round of the state at a time; then all are combined with the data at once.
    for at in range(0, n, 256):
        for i in _ROUND if n - at >= 256 else _ROUND[: n - at]:
            a = s[i]
            j = (j + a) & 255
            s[i] = b = s[j]
            s[j] = a
            out.append(s[(a + b) & 255])
    return (int.from_bytes(data, "big") ^ int.from_bytes(bytes(out), "big")).to_bytes(n, "big")


@cache
def _boxes() -> tuple[bytes, bytes, tuple]:
    """The AES substitution box, its inverse, and multiplication tables, from the field's arithmetic."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a = a << 1 ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    box = bytearray(256)
    for x in range(256):
        inverse = next((y for y in range(256) if times(x, y) == 1), 0)
        y = inverse
        for shift in range(1, 5):
            y ^= (inverse << shift | inverse >> (8 - shift)) & 255
        box[x] = y ^ 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back), tuple(bytes(times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14))


def _round_keys(key: bytes) -> list[bytes]:
    box = _boxes()[0]
    words, n, rcon = [key[i : i + 4] for i in range(0, len(key), 4)], len(key) // 4, 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = bytes([box[w[1]] ^ rcon, box[w[2]], box[w[3]], box[w[0]]])
            rcon = rcon << 1 ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and len(words) % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[-n], strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(16, "big")


_IN = [0, 13, 10, 7, 4, 1, 14, 11, 8, 5, 2, 15, 12, 9, 6, 3]
_OUT = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]


def aes_decrypt(key: bytes, iv: bytes, data: bytes, unpad: bool = True) -> bytes:
    """AES in CBC mode."""
    _, back, (_, _, m9, m11, m13, m14) = _boxes()
    keys, out = _round_keys(key), []
    for at in range(0, len(data) - 15, 16):
        block = data[at : at + 16]
        s = _xor(block, keys[-1])
        for k in reversed(keys[:-1]):
            s = _xor(bytes(back[s[i]] for i in _IN), k)
            if k is not keys[0]:
                s = bytes(
                    v for c in range(0, 16, 4) for a, b, d, e in (s[c : c + 4],)
                    for v in (m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e])
                )
        out.append(_xor(s, iv))
        iv = block
    plain = b"".join(out)
    return plain[: -plain[-1]] if unpad and plain and 1 <= plain[-1] <= 16 else plain


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """AES in CBC mode over whole blocks."""
    box, _, (m2, m3, *_) = _boxes()
    keys, out = _round_keys(key), []
    for at in range(0, len(data), 16):
        s = _xor(_xor(data[at : at + 16], iv), keys[0])
        for k in keys[1:]:
            s = bytes(box[s[i]] for i in _OUT)
            if k is not keys[-1]:
                s = bytes(v for c in range(0, 16, 4) for a, b, d, e in (s[c : c + 4],) for v in (m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e]))
            s = _xor(s, k)
        out.append(iv := s)
    return b"".join(out)


def _hash6(password: bytes, salt: bytes, user: bytes) -> bytes:
    """The hardened hash of revision 6."""
    k, i = sha256(password + salt + user).digest(), 0
    while True:
        e = aes_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Sealed(Stream):
    """A stream whose bytes are decrypted by RC4 when they are first asked for."""

    __slots__ = ("held", "key")

    def __init__(self, dictionary: dict, held: bytes, key: bytes):
        self.dict, self.held, self.key = dictionary, held, key

    @property
    def raw(self) -> bytes:
        if self.key is not None:
            self.held, self.key = rc4(self.key, self.held), None
        return self.held


class Handler:
    """Opens strings and streams of one file; raises WrongPassword."""

    def __init__(self, encrypt: dict, file_id: bytes, password: bytes):
        self.v, self.r = encrypt.get("V", 0), encrypt.get("R", 2)
        self.o, self.u, self.p = bytes(encrypt.get("O", b"")), bytes(encrypt.get("U", b"")), int(encrypt.get("P", 0)) & 0xFFFFFFFF
        length = encrypt.get("Length", 40)
        self.n = 5 if self.v == 1 else min(16, max(5, (length if isinstance(length, int) else 40) // 8))
        self.id, self.clear = file_id, encrypt.get("EncryptMetadata") is not False
        method = "V2"
        if self.v >= 4:
            filters, name = encrypt.get("CF"), encrypt.get("StmF", Name("Identity"))
            chosen = filters.get(name, {}) if isinstance(filters, dict) else {}
            method = str(chosen.get("CFM", "None")) if isinstance(chosen, dict) else "None"
            self.n = 16 if self.v == 4 else 32
        self.method = method
        self.key = self._key5(password, encrypt) if self.v >= 5 else self._key4(password)

    def _pad(self, password: bytes) -> bytes:
        return (password + PADDING)[:32]

    def _file_key(self, password: bytes) -> bytes:
        h = md5(self._pad(password) + self.o[:32] + self.p.to_bytes(4, "little") + self.id + (b"\xff" * 4 if self.r >= 4 and not self.clear else b"")).digest()
        if self.r >= 3:
            for _ in range(50):
                h = md5(h[: self.n]).digest()
        return h[: self.n]

    def _user(self, key: bytes) -> bytes:
        if self.r == 2:
            return rc4(key, PADDING)
        out = rc4(key, md5(PADDING + self.id).digest())
        for i in range(1, 20):
            out = rc4(bytes(b ^ i for b in key), out)
        return out

    def owner_key(self, owner: bytes) -> bytes:
        h = md5(self._pad(owner)).digest()
        if self.r >= 3:
            for _ in range(50):
                h = md5(h[: self.n]).digest()
        return h[: self.n]

    def _key4(self, password: bytes) -> bytes:
        n = 32 if self.r == 2 else 16
        key = self._file_key(password)
        if self._user(key)[:n] == self.u[:n]:
            return key
        by, user = self.owner_key(password), self.o[:32]
        for i in [0] if self.r == 2 else range(19, -1, -1):
            user = rc4(bytes(b ^ i for b in by), user)
        key = self._file_key(user)
        if self._user(key)[:n] == self.u[:n]:
            return key
        raise WrongPassword("neither the user's nor the owner's password")

    def _key5(self, password: bytes, encrypt: dict) -> bytes:
        password, digest = password[:127], _hash6 if self.r >= 6 else lambda p, s, u: sha256(p + s + u).digest()
        for held, sealed, extra in ((self.u, "UE", b""), (self.o, "OE", self.u[:48])):
            if len(held) >= 48 and digest(password, held[32:40], extra) == held[:32]:
                return aes_decrypt(digest(password, held[40:48], extra), bytes(16), bytes(encrypt.get(sealed, b""))[:32], unpad=False)
        raise WrongPassword("neither the user's nor the owner's password")

    def _object_key(self, num: int, gen: int) -> bytes:
        if self.v >= 5:
            return self.key
        salt = num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.method == "AESV2" else b"")
        return md5(self.key + salt).digest()[: min(16, self.n + 5)]

    def _open(self, data: bytes, num: int, gen: int) -> bytes:
        if self.method in ("None", "Identity"):
            return data
        key = self._object_key(num, gen)
        return rc4(key, data) if self.method == "V2" else aes_decrypt(key, data[:16], data[16:])

    def opened(self, value, num: int, gen: int):
        """The value with its strings and stream decrypted."""
        if isinstance(value, Text):
            out = Text(self._open(bytes(value), num, gen))
            out.hex = value.hex
            return out
        if isinstance(value, list):
            return [self.opened(v, num, gen) for v in value]
        if isinstance(value, dict):
            return {k: self.opened(v, num, gen) for k, v in value.items()}
        if isinstance(value, Stream):
            if value.dict.get("Type") == "XRef":
                return value
            entries = self.opened(value.dict, num, gen)
            if self.method == "V2" and (key := self._object_key(num, gen)):
                return Sealed(entries, value.raw, key)
            return Stream(entries, self._open(value.raw, num, gen))
        return value


def algorithm(v: int, length: int) -> str:
    # What /V stands for.
    names = {0: "Undocumented", 1: "RC4, 40-bit", 2: f"RC4, {length if length > 0 else 40}-bit", 3: "Unpublished", 4: "AES-128", 5: "AES-256"}
    return names.get(v, f"Unknown (V={v})")


def permissions(p: int) -> dict[str, bool]:
    return {name: bool((p & 0xFFFFFFFF) >> bit & 1) for name, bit in PERMISSIONS.items()}
