"""The seven rule detectors."""

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.validators import luhn_valid, national_id_valid
from .detector import RuleDetector


def _has(word):
    return lambda text: F.contains(text, F.lit(word))


def _matches(pattern):
    return lambda text: text.rlike(pattern)


_HAS_NUMBER = _matches(P.NUMBER_GUARD)

# Names, types, windows, scores and keywords of the detectors.
EMAIL = RuleDetector(
    name="RegexEmailScanner",
    pii_type="EMAIL",
    pattern=P.EMAIL,
    group=1,
    score=0.7,
    has_location=False,
    guards=[_has("@")],
)
CREDIT_CARD = RuleDetector(
    name="RegexCreditCardScanner",
    pii_type="CREDIT_CARD",
    pattern=P.CARD,
    score=1.0,
    validator=luhn_valid,
    guards=[_HAS_NUMBER],
)
NATIONAL_ID = RuleDetector(
    name="RegexTaiwanIdScanner",
    pii_type="TAIWAN_ID_CARD",
    pattern=P.NATIONAL_ID,
    score=1.0,
    validator=national_id_valid,
    guards=[_HAS_NUMBER, _matches(P.NATIONAL_ID_GUARD)],
)
HEALTH_INSURANCE = RuleDetector(
    name="RegexHealthInsuranceScanner",
    pii_type="NHI_NUMBER",
    pattern=P.HEALTH_INSURANCE,
    score=0.5,
    positive=["健保卡", "健保號", "NHI No"],
    negative=["訂單號", "會員編號", "快遞單號", "案件編號"],
    guards=[_HAS_NUMBER, _matches(P.HEALTH_INSURANCE_GUARD)],
)
PASSPORT = RuleDetector(
    name="RegexPassportScanner",
    pii_type="PASSPORT_NUMBER",
    pattern=P.PASSPORT,
    score=0.5,
    positive=["護照", "PASSPORT", "護照號", "PASSPORT NO", "出國", "僑委會", "外交部"],
    negative=["訂單", "編號", "統一編號", "收據", "發票", "會員", "貨號", "產品"],
    guards=[_HAS_NUMBER, _matches(P.PASSPORT_GUARD)],
)
PHONE = RuleDetector(
    name="RegexPhoneScanner",
    pii_type="PHONE_NUMBER",
    pattern=P.PHONE,
    score=0.5,
    positive=["電話", "手機", "市話", "專線", "致電", "TEL", "Phone", "Cell"],
    negative=["訂單", "編號", "發票", "貨號", "郵遞區號"],
    ignore_case=True,
    guards=[_HAS_NUMBER],
)
ADDRESS = RuleDetector(
    name="RegexAddressScanner",
    pii_type="ADDRESS",
    pattern=P.ADDRESS,
    group=1,
    window=100,
    score=0.85,
    guards=[_has("號"), _matches(P.ADDRESS_GUARD)],
)

BUILTIN = [EMAIL, CREDIT_CARD, NATIONAL_ID, HEALTH_INSURANCE, PASSPORT, PHONE, ADDRESS]
