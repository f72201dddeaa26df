"""SHA-256 whose state can be handed on, so that a digest begun in one task goes on in another.

``hashlib`` keeps the state to itself. libcrypto, which it calls, has it in a plain struct (``SHA256_CTX``, no pointers),
here as bytes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from functools import lru_cache

#: room for a SHA256_CTX, which takes 112 bytes
STATE_BYTES = 128


@lru_cache(1)
def _lib() -> ctypes.CDLL:
    lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
    lib.SHA256_Init.argtypes = (ctypes.c_char_p,)
    lib.SHA256_Update.argtypes = (ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t)
    lib.SHA256_Final.argtypes = (ctypes.c_char_p, ctypes.c_char_p)
    return lib


def available() -> bool:
    try:
        return _lib() is not None
    except (OSError, AttributeError):
        return False


def begin() -> bytes:
    """The state before any byte."""
    state = ctypes.create_string_buffer(STATE_BYTES)
    _lib().SHA256_Init(state)
    return state.raw


def update(state: bytes, data: bytes) -> bytes:
    """The state after ``data``; ``state`` itself stays as it is."""
    after = ctypes.create_string_buffer(state, STATE_BYTES)
    _lib().SHA256_Update(after, data, len(data))
    return after.raw


def hexdigest(state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    _lib().SHA256_Final(out, ctypes.create_string_buffer(state, STATE_BYTES))
    return out.raw.hex()
