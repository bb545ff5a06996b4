"""A table of URL rules for hosts and paths that say what they are, put together from words, signs and places.

Each word stands for rules on host labels (``word.``, ``word-suffix.``, ``prefix-word.``, with a number at the end or not) and on whole path
segments; they are of a lower rank than rules that name a host, and block. No rule is a regular expression without a literal.
"""

from __future__ import annotations

from itertools import product

from cytoframe.llm.urls import UrlRule

#: Words of advertising, spam, gambling and malware hosts.
HOST_WORDS = (
    "adserver adclick adnetwork adtracker bannerads popunder clickbait linkfarm spam spamsite malware phishing warez keygen crackz torrentz "
    "casino poker betting jackpot slotmachine lottery payday quickloan forex viagra cialis pharmacheap weightloss replica counterfeit "
    "escort adultcam xxxvideo pornhub hookup botnet exploitkit trojan keylogger scareware freeprize giveaway surveyscam cryptodouble"
).split()
#: What such a label begins or ends with.
PREFIXES = "best cheap free get my online super top".split()
SUFFIXES = "club deals farm hub now online shop site world zone".split()
#: Path segments that say the same on any host.
PATH_WORDS = "adclick affiliate-redirect banner-click casino-bonus doorway free-prize linkfarm malware-download phishing-login spam-comments warez-download".split()
PATH_ENDS = "go in out track view".split()


def labels() -> list[str]:
    """Host labels, without what may follow them: every word alone, after a prefix, before a suffix, and between both."""
    return ["spam-farm", *("-".join(filter(None, x)) for x in product(["", *PREFIXES], HOST_WORDS, ["", *SUFFIXES]))]


def labels_pattern() -> str:
    """One expression for all of them."""
    return f"(?:spam-farm|(?:(?:{'|'.join(PREFIXES)})-)?(?:{'|'.join(HOST_WORDS)})(?:-(?:{'|'.join(SUFFIXES)}))?)"


def segments() -> list[str]:
    return [*PATH_WORDS, *(f"{w}-{e}" for w, e in product(PATH_WORDS, PATH_ENDS))]


def blocked() -> list[UrlRule]:
    """Rules on host labels, followed by a number or not, and on path segments."""
    hosts = [UrlRule(f"~{w}", rf"^(?:[^/]*\.)?{w}(?:-[0-9]+)?\.", tuple(w.split("-")), "block", 0) for w in labels()]
    paths = [UrlRule(f"~/{s}/", rf"^[^/]*/(?:[^/]*/)*{s}(?:/|$)", tuple(s.split("-")), "block", 0) for s in segments()]
    return hosts + paths
