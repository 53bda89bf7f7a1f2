"""The queries of this subpackage, and their SQL where DuckDB can state it."""

from __future__ import annotations

from . import decontaminate, langid, licenses, lines, minhash, mixing, quality, secrets, syncmers, warc

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_minhash": minhash.op2_minhash,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_licenses": licenses.op4_licenses,
    "op5_warc": warc.op5_warc,
    "op6_langid": langid.op6_langid,
    "op7_syncmers": syncmers.op7_syncmers,
    "op8_quality": quality.op8_quality,
    "op9_secrets": secrets.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op2_minhash": minhash.SQL, "op4_licenses": licenses.SQL, "op5_warc": warc.SQL}
