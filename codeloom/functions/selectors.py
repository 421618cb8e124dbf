"""Selectors of site rules as regular expressions over an element's chain of opening tags."""

from __future__ import annotations

import re

_PART = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<val>[^"]*)")?\]""")


def _compound(text: str) -> str:
    tag, tests = r"[a-zA-Z][\w-]*", []
    for m in _PART.finditer(text):
        if m["tag"]:
            tag = re.escape(m["tag"])
        elif m["cls"]:
            tests.append(rf'(?=[^>]*\sclass="(?:[^"]*\s)?{re.escape(m["cls"])}(?:\s[^"]*)?")')
        elif m["val"] is None:
            tests.append(rf'(?=[^>]*\s{re.escape(m["attr"])}[\s=>])')
        else:
            value = re.escape(m["val"])
            inner = f'[^"]*{value}[^"]*' if m["op"] == "*=" else value
            tests.append(rf'(?=[^>]*\s{re.escape(m["attr"])}="{inner}")')
    return rf"<{tag}(?=[\s>/]){''.join(tests)}[^>]*>"


def chain_pattern(selector: str) -> str:
    """``div[class*="x"] pre > code`` as a pattern that matches the whole chain ending in the element."""
    out, child = "", False
    for i, token in enumerate(selector.split()):
        if token == ">":
            child = True
            continue
        out += ("" if child or i == 0 else r"(?:<[^>]*>)*") + _compound(token)
        child = False
    return out + r"\z"


def tag_pattern(selector: str) -> str:
    """The opening tag of the element that a selector picks, whatever stands around it."""
    return _compound(selector.split()[-1])
