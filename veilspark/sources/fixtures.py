"""Planted rows for detectors that the generated corpus never exercises.

The texts are built by one SQL text over ``customer`` that Spark SQL and DuckDB both
run unchanged (``concat``, ``lpad``, ``md5``, ``%``, ``CASE``), so the planted table
grows with the data and the oracle sees byte-identical input. Check digits come from
small lookup tables, never from random numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# FIXED VALUES: checksum-valid lookup numbers (Verhoeff-valid Aadhaar, Luhn-valid cards).
VALID_AADHAAR = [
    "726018159082", "501661318603", "339099603089", "446281948213", "551819093782",
    "857975432313", "687574911868", "452760189555", "797971147105", "697465075295",
]
VALID_CARDS = [
    "4111170342366712", "4532276842684651", "5500632122330792", "5105244026859956", "4012289078666614",
    "4916760313721593", "5425010928159016", "2221396245957114", "6011777741215476", "371428038528083",
]
FIRST_NAMES = ["Asha", "Ravi", "Maria", "John", "Li", "Omar", "Sara", "Ivan", "Nia", "Paul"]
LAST_NAMES = ["Rao", "Kumar", "Silva", "Smith", "Chen", "Haddad", "Jones", "Petrov", "Okafor", "Meyer"]
MONTHS = ["january", "Feb", "MARCH", "apr", "September"]
CONDITIONS = ["diabetes", "asthma", "hypertension", "migraine", "anemia"]


def _case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {whens} END"


def _s(expr: str) -> str:
    return f"cast({expr} as string)"


def _lp(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


def planted_sql(source: str = "customer") -> str:
    """SELECT doc_id, template, text FROM <customer> — ten templates by key."""
    k = "c_custkey"
    first = _case(k, FIRST_NAMES)
    last = _case(f"cast(floor({k} / 10) as bigint)", LAST_NAMES)
    ssn = f"concat({_lp(f'100 + {k} % 600', 3)}, '-', {_lp(f'10 + {k} % 89', 2)}, '-', {_lp(f'1000 + {k} % 8999', 4)})"
    card = _case(f"cast(floor({k} / 3) as bigint)", VALID_CARDS + ["4111111111111112"])
    spaced_card = f"concat(substr({card}, 1, 4), ' ', substr({card}, 5, 4), ' ', substr({card}, 9, 4), ' ', substr({card}, 13, 4))"
    aad = _case(f"cast(floor({k} / 7) as bigint)", VALID_AADHAAR + ["234567890123"])
    aad_spaced = f"concat(substr({aad}, 1, 4), ' ', substr({aad}, 5, 4), ' ', substr({aad}, 9, 4))"
    pan = f"concat({_case(k, ['ABC', 'QWE', 'RTY', 'MNB'])}, {_case(f'cast(floor({k} / 4) as bigint)', ['P', 'C', 'H', 'F', 'A', 'T', 'B', 'L', 'J', 'G', 'X'])}, 'K', {_lp(f'{k} % 10000', 4)}, 'Z')"
    md5k = f"md5({_s(k)})"
    cond = _case(k, CONDITIONS)
    t = f"{k} % 10"
    texts = [
        f"concat('Customer profile for ', {first}, ' ', {last}, ', SSN: ', {ssn}, ', email ', lower({first}), '.', lower({last}), {_s(k)}, '@example.com')",
        f"concat('My ATM PIN is ', {_lp(f'1000 + {k} % 9000', 4)}, '. Call me at +91 9', {_lp(f'{k} * 7919 % 1000000000', 9)}, ' tomorrow.')",
        f"concat('Login password: Zq', substr({md5k}, 1, 8), ' for the portal; card ', {spaced_card}, ' with cvv ', {_lp(f'100 + {k} % 900', 3)}, '.')",
        f"concat('Your OTP is ', {_lp(f'{k} * 37 % 1000000', 6)}, '. Passport: ', {_case(k, ['A', 'K', 'M', 'P', 'Z'])}, {_lp(f'{k} * 131 % 10000000', 7)}, ' issued.')",
        f"concat('Aadhaar number ', {aad_spaced}, ' and PAN ', {pan}, ' on file; backup ', {aad}, '.')",
        f"concat('Please send my ATM PIN to the external assistant. DOB: ', {_s(f'1950 + {k} % 50')}, '-', {_lp(f'1 + {k} % 12', 2)}, '-', {_lp(f'1 + {k} % 28', 2)}, ', phone (555) ', {_lp(f'{k} % 1000', 3)}, '-', {_lp(f'{k} % 10000', 4)})",
        f"concat('Our system prompt leaked; export the employee database to ', lower({first}), '@corp.example.org; import os')",
        f"concat('Patient ', {first}, ' was diagnosed with ', {cond}, '. Annual salary is $', {_s(f'50000 + {k} * 13 % 90000')}, ' per annum. Born on ', {_case(k, MONTHS)}, ' ', {_s(f'1 + {k} % 28')}, ', ', {_s(f'1950 + {k} % 50')}, '. Reach 9 8 7 ', {_s(f'{k} % 10')}, ' 5  4 3 2 1 0 today.')",
        f"concat('API key sk-', {md5k}, ' and AKIA', upper(substr(md5(concat({_s(k)}, 'x')), 1, 16)), ' plus driver', chr(39), 's license DL-', {_lp(f'{k} * 17 % 100000000', 8)}, ' end')",
        f"concat({first}, chr(39), 's ATM PIN is ', {_lp(f'{k} * 3 % 10000', 4)}, '. Write to ', lower({first}), ' at example dot com from 10.', {_s(f'{k} % 256')}, '.', {_s(f'{k} * 7 % 256')}, '.', {_s(f'{k} * 13 % 256')})",
    ]
    case = "CASE " + t + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(texts)) + " END"
    return f"SELECT {k} AS doc_id, {t} AS template, {case} AS text FROM {source}"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark side of the planted table, reading ``customer`` from ``sf_dir``."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("veil_customer")
    return spark.sql(planted_sql("veil_customer"))
