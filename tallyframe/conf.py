"""Compiler options that change results. A plan is built for one ``CobolConf``."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CobolConf:
    trunc: str = "STD"  # STD | BIN | OPT
    arith: str = "COMPAT"  # COMPAT (18 digits) | EXTEND (31)
    decimal_point: str = "."
    currency: str = "$"
    numproc: str = "NOPFD"
    codepage: str = "cp037"
    tally_adds: bool = False  # INSPECT TALLYING: the counter is set, or added to
    run_date: str = "20000101"
    run_time: str = "00000000"

    @property
    def precision(self) -> int:
        return 18 if self.arith == "COMPAT" else 31


def detect(source: str, conf: CobolConf | None = None) -> CobolConf:
    """Options of ``CBL``/``PROCESS`` cards and of SPECIAL-NAMES."""
    conf = conf or CobolConf()
    cards = " ".join(m[1] for m in re.finditer(r"(?im)^\s{0,7}(?:CBL|PROCESS)\s+(.*)$", source))
    for name, values in (("trunc", "STD|BIN|OPT"), ("arith", "COMPAT|EXTEND"), ("numproc", "NOPFD|PFD|MIG")):
        if m := re.search(rf"(?i)\b{name}\s*\(\s*({values})\w*\s*\)", cards):
            conf = replace(conf, **{name: m[1].upper()})
    if m := re.search(r"(?i)\bcodepage\s*\(\s*(\d+)\s*\)", cards):
        page = {"37": "cp037", "037": "cp037", "500": "cp500", "1047": "cp1047", "1140": "cp037"}.get(m[1].lstrip("0") or m[1])
        conf = replace(conf, codepage=page or conf.codepage)
    if re.search(r"(?i)\bDECIMAL-POINT\s+IS\s+COMMA\b", source):
        conf = replace(conf, decimal_point=",")
    if m := re.search(r"(?i)\bCURRENCY\s+SIGN\s+IS\s+['\"](.)['\"]", source):
        conf = replace(conf, currency=m[1])
    return conf
