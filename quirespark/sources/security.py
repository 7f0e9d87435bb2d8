"""The standard security handler of PDF files, for files that open with an empty password: RC4 and AES in CBC mode.

Tables of the cipher are built from the field's arithmetic. Blocks of a stream are decrypted side by side as rows of an array.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np

# Fixed value: what fills a password up to 32 bytes.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class Locked(ValueError):
    """A file that an empty password doesn't open."""


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        a = state[i]
        j = (j + a) & 255
        b = state[j]
        state[i], state[j] = b, a
        out[k] = byte ^ state[(a + b) & 255]
    return bytes(out)


# --- AES ---------------------------------------------------------------------


def product(a: int, b: int) -> int:
    """In the field of 256 elements that the cipher counts in."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    power, inverse = 1, [0] * 256
    powers = []
    for _ in range(255):  # 3 generates all elements but 0
        powers.append(power)
        power = product(power, 3)
    for i, p in enumerate(powers):
        inverse[p] = powers[-i % 255]
    for x in range(256):
        b = inverse[x]
        turned = b
        for k in range(1, 5):
            turned ^= ((b << k) | (b >> (8 - k))) & 255
        table[x] = turned ^ 0x63
    return table


SUBSTITUTED = _substitution()
RESTORED = np.argsort(SUBSTITUTED).astype(np.uint8)
MULTIPLES = {n: np.array([product(x, n) for x in range(256)], np.uint8) for n in (2, 3, 9, 11, 13, 14)}
#: Places of the bytes of a block after its rows were shifted, and back.
SHIFTED = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
UNSHIFTED = np.argsort(SHIFTED)


def round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words, round_constant = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        word = list(words[-1])
        if i % n == 0:
            word = [int(SUBSTITUTED[x]) for x in word[1:] + word[:1]]
            word[0] ^= round_constant
            round_constant = product(round_constant, 2)
        elif n > 6 and i % n == 4:
            word = [int(SUBSTITUTED[x]) for x in word]
        words.append([a ^ b for a, b in zip(words[i - n], word, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


def mixed(blocks: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    """Every column of every block multiplied with the matrix whose first row is ``factors``."""
    columns = blocks.reshape(-1, 4, 4)
    out = np.zeros_like(columns)
    for row in range(4):
        for k in range(4):
            n = factors[(k - row) % 4]
            out[:, :, row] ^= columns[:, :, k] if n == 1 else MULTIPLES[n][columns[:, :, k]]
    return out.reshape(-1, 16)


def decrypted(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    blocks = blocks ^ keys[-1]
    for i in range(len(keys) - 2, -1, -1):
        blocks = RESTORED[blocks[:, UNSHIFTED]] ^ keys[i]
        if i:
            blocks = mixed(blocks, (14, 11, 13, 9))
    return blocks


#: A byte's share of a column after substitution and mixing, by the byte's row.
SHARES = [[int.from_bytes(bytes(product(int(SUBSTITUTED[x]), f) for f in ((2, 1, 1, 3) * 2)[(4 - row) % 4 :][:4]), "big") for x in range(256)] for row in range(4)]


def cbc_encrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    """Of whole blocks, each after the one before: columns as numbers, as there is nothing to do side by side."""
    keys = [int.from_bytes(row[4 * i : 4 * i + 4], "big") for row in (r.tobytes() for r in round_keys(key)) for i in range(4)]
    plain = SUBSTITUTED.tolist()
    t0, t1, t2, t3 = SHARES
    a, b, c, d = (int.from_bytes(start[4 * i : 4 * i + 4], "big") for i in range(4))
    out, last = [], len(keys) - 4
    for at in range(0, len(data), 16):
        a ^= int.from_bytes(data[at : at + 4], "big") ^ keys[0]
        b ^= int.from_bytes(data[at + 4 : at + 8], "big") ^ keys[1]
        c ^= int.from_bytes(data[at + 8 : at + 12], "big") ^ keys[2]
        d ^= int.from_bytes(data[at + 12 : at + 16], "big") ^ keys[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ keys[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ keys[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ keys[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ keys[k + 3],
            )
        a, b, c, d = (
            (plain[w >> 24] << 24 | plain[x >> 16 & 255] << 16 | plain[y >> 8 & 255] << 8 | plain[z & 255]) ^ keys[last + i]
            for i, (w, x, y, z) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)))
        )
        out.append((a << 96 | b << 64 | c << 32 | d).to_bytes(16, "big"))
    return b"".join(out)


def cbc_decrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks):
        return b""
    before = np.concatenate([np.frombuffer(start, np.uint8)[None], blocks[:-1]])
    return (decrypted(round_keys(key), blocks) ^ before).tobytes()


def aes(key: bytes, data: bytes) -> bytes:
    """A string or stream: its first block starts the chain, and its last byte says how many bytes fill it up."""
    plain = cbc_decrypted(key, data[:16], data[16:]) if len(data) >= 32 else b""
    return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain


# --- the handler -------------------------------------------------------------


def hardened(password: bytes, salt: bytes, revision: int) -> bytes:
    """The digest of a password, of files with 256-bit keys; from revision 6 on in many rounds."""
    key = hashlib.sha256(password + salt).digest()
    if revision < 6:
        return key
    number, last = 0, 0
    while number < 64 or last > number - 32:
        rows = cbc_encrypted(key[:16], key[16:32], (password + key) * 64)
        kind = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(rows[:16]) % 3]
        key, last = kind(rows).digest(), rows[-1]
        number += 1
    return key[:32]


class Handler:
    """Decrypts what objects hold; made of a file's ``Encrypt`` dictionary and the first part of its ID."""

    def __init__(self, entry: dict, file_id: bytes):
        number = lambda name, default: entry[name] if isinstance(entry.get(name), int) else default
        version, revision = number("V", 0), number("R", 0)
        if entry.get("Filter") != "Standard" or version not in (1, 2, 4, 5) or not isinstance(entry.get("U"), bytes) or not isinstance(entry.get("O"), bytes):
            raise Locked("the file is encrypted in a way that isn't read")
        self.whole = version == 5
        filters = entry.get("CF") if isinstance(entry.get("CF"), dict) else {}

        def method(name: str) -> str:
            if version < 4:
                return "V2"
            chosen = entry.get(name, "Identity")
            own = filters.get(chosen)
            return "None" if chosen == "Identity" else str(own.get("CFM", "None")) if isinstance(own, dict) else "None"

        self.streams, self.strings = method("StmF"), method("StrF")
        self.metadata = entry.get("EncryptMetadata", True) is not False
        owner, user = entry["O"], entry["U"]
        if self.whole:
            if hardened(b"", user[32:40], revision) != user[:32] or not isinstance(entry.get("UE"), bytes):
                raise Locked("the file is encrypted")
            self.key = cbc_decrypted(hardened(b"", user[40:48], revision), bytes(16), entry["UE"][:32])
            return
        size = number("Length", 40) // 8 if version > 1 else 5
        size = 16 if version == 4 else max(5, min(16, size))
        digest = hashlib.md5(PAD + owner[:32] + (number("P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"\xff" * 4 if revision >= 4 and not self.metadata else b"")).digest()
        for _ in range(50 if revision >= 3 else 0):
            digest = hashlib.md5(digest[:size]).digest()
        self.key = digest[:size]
        if revision < 3:
            right = rc4(self.key, PAD) == user[:32]
        else:
            proof = hashlib.md5(PAD + file_id).digest()
            for i in range(20):
                proof = rc4(bytes(x ^ i for x in self.key), proof)
            right = proof == user[:16]
        if not right:
            raise Locked("the file is encrypted")

    def plain(self, data: bytes, number: int, generation: int, method: str) -> bytes:
        if method == "None":
            return data
        if self.whole:
            return aes(self.key, data)
        own = self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b"")
        key = hashlib.md5(own).digest()[: min(len(self.key) + 5, 16)]
        return aes(key, data) if method == "AESV2" else rc4(key, data)

    def stream(self, head: dict, data: bytes, number: int, generation: int, filters: list) -> bytes:
        kind = head.get("Type")
        if kind == "XRef" or "Crypt" in filters or kind == "Metadata" and not self.metadata:
            return data
        return self.plain(data, number, generation, self.streams)

    def value(self, found: Any, number: int, generation: int) -> Any:
        """A value with its strings decrypted."""
        if type(found) is bytes:
            return self.plain(found, number, generation, self.strings)
        if isinstance(found, list):
            return [self.value(x, number, generation) for x in found]
        if isinstance(found, dict):
            return {k: self.value(x, number, generation) for k, x in found.items()}
        return found
