"""RC4 protection of old workbooks: key from password and salt, renewed every 1024 bytes."""

from __future__ import annotations

import struct
from hashlib import md5

from sheaf.errors import SheafError

#: Fixed value: the password of workbooks that are protected without one.
DEFAULT_PASSWORD = "VelvetSweatshop"
BLOCK = 1024


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def base_key(password: str, salt: bytes) -> bytes:
    head = md5(password.encode("utf-16-le")).digest()[:5]
    return md5((head + salt) * 16).digest()[:5]


def block_key(key: bytes, block: int) -> bytes:
    return md5(key + struct.pack("<I", block)).digest()


def crypt(key: bytes, data: bytes) -> bytes:
    """Encrypt or decrypt a stream from its beginning."""
    return b"".join(rc4(block_key(key, i // BLOCK), data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))


def unlock(info: bytes, password: str = DEFAULT_PASSWORD) -> bytes:
    """The key, if the password fits. info: version, salt, verifier and its hash."""
    if len(info) != 52:
        raise SheafError(f"xls: protection record has {len(info)} bytes, not 52")
    _, minor = struct.unpack_from("<2H", info)
    if minor != 1:
        raise SheafError(f"xls: unknown protection version {minor}")
    key = base_key(password, info[4:20])
    plain = rc4(block_key(key, 0), info[20:52])
    if md5(plain[:16]).digest() != plain[16:]:
        raise SheafError("xls: the password does not fit")
    return key
