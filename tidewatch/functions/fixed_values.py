"""Labels, thresholds and texts that results are compared on.

Nothing here is computed. Change a value only together with the results that depend on it.
"""

from __future__ import annotations

# Signals in mask order, weight in the combined score.
SIGNAL_WEIGHTS = {"price": 0.40, "pop": 0.25, "telecom": 0.20, "card": 0.15}

# A percentile strictly outside this band is flagged; a missing score is neutral.
BAND_LOW = 0.25
BAND_HIGH = 0.75
NEUTRAL = 0.5

# Alert labels, one per set of flagged signals, in display order.
ALERT_LABELS = [
    (("price", "pop", "telecom", "card"), "4중 동시 경보"),
    (("price", "pop", "telecom"), "3중 동시 경보"),
    (("price", "pop", "card"), "시세+전입인구+카드 경보"),
    (("price", "telecom", "card"), "시세+통신+카드 경보"),
    (("pop", "telecom", "card"), "전입인구+통신+카드 경보"),
    (("price", "pop"), "시세+전입인구 경보"),
    (("price", "telecom"), "시세+통신 경보"),
    (("price", "card"), "시세+카드 경보"),
    (("pop", "telecom"), "전입인구+통신 경보"),
    (("pop", "card"), "전입인구+카드 경보"),
    (("telecom", "card"), "통신+카드 경보"),
    (("price",), "시세 경보"),
    (("pop",), "전입인구 경보"),
    (("telecom",), "통신 경보"),
    (("card",), "카드소비 경보"),
]
QUAD_LABEL = "4중 동시 경보"
TRIPLE_LABEL = "3중 동시 경보"
TRIPLE_OR_MORE_PATTERN = "3중|4중"

# Text looked for in a label when counting alerts per signal.
LABEL_WORDS = {"price": "시세", "pop": "전입인구", "telecom": "통신", "card": "카드"}

# Display names.
SCORE_NAMES = {"price_score": "시세", "pop_score": "전입인구", "telecom_score": "통신", "card_score": "카드소비"}
ALERT_COUNT_NAMES = {
    "price_alerts": "시세",
    "pop_alerts": "전입인구",
    "telecom_alerts": "통신",
    "card_alerts": "카드소비",
}
SUMMARY_NAMES = {"combined_score": "결합", **SCORE_NAMES}
SIGNAL_TITLES = {"price": "🏠 시세", "pop": "👥 전입인구", "telecom": "📱 통신 개통", "card": "💳 카드소비(가전·가구)"}
ALERT_LIST_NAMES = {
    "region_key": "지역",
    "ym": "기준월",
    "alert_type": "경보유형",
    "combined_score": "결합점수",
    "price_score": "시세",
    "pop_score": "전입인구",
    "telecom_score": "통신",
    "card_score": "카드소비",
    "dominant_age_group": "주요연령대",
    "income_profile": "소득수준",
}
DIRECTION_TAG, DIRECTION_UP, DIRECTION_DOWN = "방향", "상승", "하락"
MISSING_TEXT = "-"
MISSING_COPY_TEXT = "문구 없음"

# Customer profile labels.
AGE_UNMATCHED = "30-40대 추정"
AGE_LABELS = {30: "30대 중심", 40: "40대 중심", 20: "20대 중심"}
AGE_MIXED = "20-50대 혼합"
INCOME_UNKNOWN = "소득 정보 없음"
INCOME_BANDS = [(0.2, "고소득 지역"), (0.1, "중고소득 지역")]
INCOME_REST = "중소득 지역"

# Traffic status labels (slow, medium, fast).
TRAFFIC_STATUS = ("혼잡", "보통", "원활")

# Region filters, district groups and placeholders of the Korean sources.
CITY = "서울"
PRICE_LEVEL = "emd"
POPULATION_LEVEL = "sgg"
MOVE_IN = "전입"
INSTALL_STATE = "서울"
PROVINCE_CODE = 11
LATE_PRICE_DISTRICTS = ("영등포구", "서초구", "중구")
RENTAL_UNCLASSIFIED = "미분류"
CALL_INBOUND = "수신"
CALL_OTHER = "기타"

# Prompt texts.
SYSTEM_PROMPT = (
    "당신은 통신·렌탈 서비스 전문 카피라이터입니다. 반드시 지역명을 포함하고, 40자 이내의 광고 문구 한 줄만 출력하세요. "
    "부가 설명, 큰따옴표, 줄바꿈 없이 문구만 출력합니다."
)
PROMPT_OPENING = "아래 조건에 맞는 이사 고객용 광고 문구를 1줄로 작성하세요."
RENTAL_MUST_MENTION = " 중 하나 반드시 언급"
AGE_FALLBACK = "30-40대"
INCOME_FALLBACK_PRICE = "중고소득"
INCOME_FALLBACK_OTHER = "중소득"
RENTAL_FALLBACK = "정수기·비데·공기청정기"
BAN_LONG = "설명 문장, 큰따옴표, 부가 설명 금지. 문구만."
BAN_SHORT = "설명 문장, 큰따옴표 금지. 문구만."
TEMPERATURE = 0.9
RESPONSE_PATH = "$.choices[0].messages"
MAX_COPY_LENGTH = 40

# One prompt template per label. `strength` and `market` may name a percentile or the score rank.
PROMPT_TEMPLATES = {
    "4중 동시 경보": {
        "strength": "4중 동시 이상 (시세·전입인구·통신·카드소비 ALL 경보)",
        "market": "시세 {price}%ile / 전입인구 {pop}%ile / 통신개통 {telecom}%ile / 카드소비 {card}%ile",
        "demand": "전 카테고리 문의 급증",
        "rental": True,
        "service": "이달 개통 시 렌탈 0원 + 기가 인터넷 결합",
        "ban": BAN_LONG,
    },
    "3중 동시 경보": {
        "strength": "상위 {top}% 수준 (시세·전입인구·통신 3중 동시 이상)",
        "market": "시세 {price}%ile / 전입인구 {pop}%ile / 통신개통 {telecom}%ile",
        "demand": "인터넷 문의 급증",
        "rental": True,
        "service": "이달 개통 시 렌탈 0원 + 기가 인터넷 결합",
        "ban": BAN_LONG,
    },
    "시세+전입인구+카드 경보": {
        "strength": "시세 {price}%ile · 전입인구 {pop}%ile · 카드소비 {card}%ile 동시 급등",
        "demand": "이사 준비 구매 급증",
        "rental": True,
        "service": "이사 전 렌탈 사전 예약 + 기가 인터넷 결합 할인",
        "condition": "이사 준비 단계 소비 언급 필수",
    },
    "시세+통신+카드 경보": {
        "strength": "시세 {price}%ile · 통신개통 {telecom}%ile · 카드소비 {card}%ile 동시 급등",
        "demand": "프리미엄 개통·구매 문의 급증",
        "service": "기가 인터넷 당일 개통 + 프리미엄 렌탈 결합 특가",
        "condition": "프리미엄·빠른 설치 강조 필수",
    },
    "전입인구+통신+카드 경보": {
        "strength": "전입인구 {pop}%ile · 통신개통 {telecom}%ile · 카드소비 {card}%ile 동시 급증",
        "demand": "입주 완료·가전 구매 동시 증가",
        "rental": True,
        "service": "입주 완료 고객 인터넷+렌탈 결합 월 최대 30% 할인",
    },
    "시세+전입인구 경보": {
        "strength": "시세 {price}%ile · 전입인구 {pop}%ile 동시 급등",
        "demand": "인터넷 문의 증가",
        "rental": True,
        "service": "이사 당일 렌탈 설치 + 기가 인터넷 결합 할인",
    },
    "시세+통신 경보": {
        "strength": "시세 {price}%ile · 통신개통 {telecom}%ile 동시 급등",
        "demand": "개통 문의 급증",
        "service": "기가 인터넷 당일 개통 + 렌탈 결합 월정액 할인",
        "condition": "인터넷 개통 언급 필수",
    },
    "시세+카드 경보": {
        "strength": "시세 {price}%ile 급등 + 카드소비 {card}%ile (가전·가구 구매 급증)",
        "demand": "이사 준비 소비 증가",
        "rental": True,
        "service": "이사 전 렌탈 사전 계약 + 기가 인터넷 조기 개통 특가",
        "condition": "이사 준비 시점 강조 필수",
    },
    "전입인구+통신 경보": {
        "strength": "전입인구 {pop}%ile · 통신개통 {telecom}%ile 동시 급증",
        "demand": "렌탈 문의 증가",
        "rental": True,
        "service": "인터넷+렌탈 결합 월 최대 30% 할인",
    },
    "전입인구+카드 경보": {
        "strength": "전입인구 {pop}%ile 급증 + 카드소비 {card}%ile (생활가전 구매 증가)",
        "demand": "이사 고객 문의 증가",
        "rental": True,
        "service": "입주 축하 렌탈+인터넷 동시 신청 시 첫 달 무료",
        "condition": "새 생활 시작 감성 필수",
    },
    "통신+카드 경보": {
        "strength": "통신개통 {telecom}%ile · 카드소비 {card}%ile 동시 급증 (입주 완료 확정 신호)",
        "demand": "개통·렌탈 동시 문의 증가",
        "rental": True,
        "service": "인터넷 개통 완료 고객 렌탈 즉시 설치 특가",
        "condition": "입주 완료 직후 시점 강조 필수",
    },
    "시세 경보": {
        "strength": "시세 상위 {price}%ile 급등 지역",
        "demand": "프리미엄 문의 증가",
        "service": "기가 인터넷 24시간 내 설치 보장",
        "condition": "프리미엄·속도 강조 필수",
    },
    "전입인구 경보": {
        "strength": "전입인구 상위 {pop}%ile 급증 지역",
        "demand": "이사 관련 문의 증가",
        "rental": True,
        "service": "이사 고객 인터넷+렌탈 동시 특가",
        "condition": "새집 시작 감성 필수",
    },
    "카드소비 경보": {
        "strength": "카드소비 상위 {card}%ile (가전·가구·할인점 소비 급증 = 이사 준비 선행 신호)",
        "demand": "이사 준비 구매 증가",
        "rental": True,
        "service": "이사 준비 고객 렌탈 사전 예약 + 인터넷 결합 할인",
        "condition": "이사 준비 단계·사전 계약 혜택 강조 필수",
    },
    "통신 경보": {
        "strength": "통신 개통 상위 {telecom}%ile 급증",
        "demand": "개통 문의 급증",
        "service": "기가 인터넷 당일 개통 + 렌탈 첫 달 무료",
        "condition": "개통 속도·첫 달 혜택 강조 필수",
    },
}
# Fixed value: the template used for a null or unknown label.
DEFAULT_TEMPLATE_LABEL = "통신 경보"
