"""Gate, slots, intents, plans and guardrails for a column of questions.

Rules are tables over named cues: the first that holds decides.  Nothing here calls a model.
Questions are Persian or English; cues are patterns that mean the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import is_valid_cas, normalize_cas, ordered_rules
from ..functions.text import latin_digits
from .rules import first_of, holds

#: The words of the domain.
DOMAIN_WORDS = """
twa stel ceiling oel oels ppm ppb mg/m3 mg/m³ exposure limit limits threshold concentration dose مواجهه حد مجاز سقف میانگین وزنی غلظت
cas chemical substance compound molecule molecular benzene benz toluene ammonia acetone formaldehyde ماده شیمیایی بنزن تولوئن آمونیاک استون
hazard risk safety health occupational workplace industrial hygiene toxicology ventilation ppe ایمنی بهداشت شغلی کار صنعتی خطر ریسک تهویه ماسک تجهیزات حفاظت
ohe6 ohe ohse hse osha acgih tlv pel regulation standard guideline recommendation prohibition استاندارد مقررات توصیه ممنوعیت
formula calculate calculation ahv ahw vibration noise laeq duration فرمول محاسبه ارتعاش صدا نویز
definition define meaning explain concept تعریف یعنی چیست چیه معنی توضیح مفهوم bei biological biomarker زیستی بیولوژ
source page table provenance reference منبع صفحه جدول more compare comparison مقایسه بیشتر چنده چقدر چقدره
""".split()
#: Persian names of substances that count once more.
PERSIAN_NAMES = ["بنزن", "تولوئن", "آمونیاک", "استون", "فرمالدئید"]

#: What attacks, abuses, or is about something else.
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"disregard\s+(your\s+)?(instructions?|rules?|guidelines?)",
    r"forget\s+(everything|all|your)\s+(you\s+)?(know|instructions?|rules?)",
    r"you\s+are\s+now\s+(a|an)\s+\w+",
    r"act\s+as\s+(if\s+you\s+are\s+)?(a|an)\s+\w+\s+(ai|assistant|bot)",
    r"system\s*:\s*",
    r"<\s*/?\s*(system|prompt|instruction)\s*>",
    r"\[\s*INST\s*\]",
    r"###\s*(system|instruction|human|assistant)",
    r"do\s+not\s+follow\s+(your|the)\s+(rules?|guidelines?|instructions?)",
    r"override\s+(safety|security|guardrail)",
    r"(reveal|print)\s+(your\s+)?(system\s+)?prompt",
    r"show\s+(me\s+)?(your\s+)?(system\s+)?(prompt|instructions?)",
    r"DAN\s+mode|jailbreak",
    r"bypass\s+(filter|guardrail|safety|restriction)",
    r"SQL\s+injection|DROP\s+TABLE|;\s*--|UNION\s+SELECT",
    r"<script[\s>]|javascript\s*:|on\w+\s*=",
    r"eval\s*\(|exec\s*\(|__import__|os\.system|subprocess\.",
    r"دستور\s+سیستم|نادیده\s+بگیر|فراموش\s+کن|نقش\s+تو\s+را\s+عوض\s+کن",
]
ABUSE = [
    r"\b(hack|exploit|attack|malware|ransomware|phishing)\b",
    r"\b(kill|murder|bomb|weapon|terror)\b",
    r"\b(drug\s+deal|illegal\s+substance)\b",
    r"how\s+to\s+(make|build|create)\s+(a\s+)?(bomb|weapon|poison|drug)",
    r"چطور\s+(بسازم|درست\s+کنم)\s+(بمب|سلاح|ماده\s+مخدر)",
]
MOOD = r"دلم(?:\s+\S+){0,4}\s*گرفته|حوصله\s*ندار|نمی\s*خوام|نمیخوام|بیخیال|don't\s*want|feeling\s*down|i\s*am\s*sad|not\s*interested"
OFF_DOMAIN = [
    r"\b(weather|forecast|temperature\s+today)\b",
    r"\b(football|soccer|basketball|sport|match\s+score)\b",
    r"\b(movie|film|series|netflix|music|song|album)\b",
    r"\b(recipe|cooking|restaurant|food\s+delivery)\b",
    r"\b(stock\s+market|crypto|bitcoin|forex|trading)\b",
    r"\b(dating|relationship|marriage\s+advice)\b",
    r"\b(homework|math\s+problem|solve\s+equation|calculate\s+\d)\b",
    r"\b(translate\s+this|translation\s+of)\b",
    r"\b(joke|funny|meme|story|poem)\b",
    r"\b(pizza|burger|coffee\s+shop)\b",
    r"\b(capital\s+of|population\s+of|president\s+of)\b",
    r"\b(news|politics|election|vote)\b",
    r"\b(lose\s+weight|diet\s+plan|gym\s+workout)\b",
    r"\b(write\s+me|compose|generate\s+a)\b",
    r"آب\s+و\s+هوا|فوتبال|والیبال|بسکتبال|فیلم|سریال|موسیقی|آهنگ|دستور\s+پخت|غذا|رستوران|بورس|ارز\s+دیجیتال|بیت\s*کوین|جوک|طنز|داستان\s+خنده",
    MOOD,
]


def _whole(words: str) -> str:
    """The words as whole words of any script."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


_SET = r"(?:=|:|برابر(?:\s*با)?)\s*"
_MEANING = r"یعنی|چیست|چیه|تعریف|معنا|چه مفهوم|توضیح|\bwhat (?:is|does|are)\b|\bdefin|\bmeaning\b|\bexplain"

#: What a question may have in it.
CUES = {
    "control": r"[\x00-\x08\x0b\x0c\x0e-\x1f]",
    "injection": "|".join(INJECTION),
    "abuse": "|".join(ABUSE),
    "off_domain": "|".join(OFF_DOMAIN),
    "task": r"حد|TWA|STEL|Ceiling|سقف|CAS|MW|ppm|ppb|mg/m|مواجهه|BEI|فرمول|formula_|محاسبه|ahv|ahw|تعریف|یعنی|چیست|چیه|چنده|چقدر|مقایسه|منبع|صفحه|جدول|وزن\s*مولکول|molecular\s*weight|exposure|limit",
    "strong": r"وزن\s*مولکول|molecular\s*weight|\bMW\b|TWA|STEL|Ceiling|\bCAS\b|formula_\d+|BEI|حد\s|مواجهه|فرمول|ahv|محاسبه",
    "follow_up": r"^(?:STEL|TWA|Ceiling|سقف|CAS|MW|منبع|فرمول|ahv|نداره؟|چنده؟|چقدره؟|همون|اون|اش|ش؟|پس |باز |دوباره |حد؟|بیشتره؟)",
    "mood": MOOD,
    "judgment": r"اخراج|تعلیق|تشخیص بیماری|" + _whole("بیمار") + r"|\bdiagnos|am i safe|should i (?:quit|worry)",
    "long_shift": r"(?:^|\D)(?:1[3-9]|[2-9]\d)\s*(?:ساعت|hours?\b)",
    "limit": _whole("حد") + r"|\blimits?\b",
    "exposure": r"مواجهه|exposure",
    "letters_for_number": rf"\b(?:ahw|t)\d*\s*{_SET}[a-zآ-ی]+",
    "bad_number": rf"ahw_?\d*\s*{_SET}-\d|\bt_?\d*\s*{_SET}(?:-\d|0+(?:\.0+)?(?:$|[^\d.]))",
    "asks_valid": r"معتبر|صحیح|درست است|\bvalid\b|\bcorrect\b",
    "conflict": r"دو\s*مقدار\s*مختلف|دو\s*عدد\s*متفاوت|متناقض|تناقض|\bconflicting\b|\bcontradict",
    "placeholder": r"\b(?:Unknown|NonExistent|Fake|Invalid)\w*-?\d{2,}\b",
    "how_much": r"چقدر|چنده|\bhow much\b",
    "define": _MEANING,
    "and": r"\sو\s|\sand\s",
    "compare": r"مقایسه|\bcompar",
    "twa": r"\bTWA\b",
    "stel": r"\bSTEL\b",
    "ceiling": r"\bCeiling\b|سقف",
    "two_types": r"\b(?:TWA\b.*\b(?:STEL|CEILING|OEL)|STEL\b.*\b(?:TWA|CEILING|OEL)|CEILING\b.*\b(?:TWA|STEL|OEL)|OEL\b.*\b(?:TWA|STEL|CEILING))\b",
    "amount": r"ppm|مواجهه|غلظت|\bconcentration",
    "relation": r"بیشتر|مقایسه|نسبت|\bexceed|\bversus\b|\bhigher\b",
    "fifteen": r"۱۵\s*دقیقه|15\s*min|STEL",
    "number_ppm": r"\d+\s*ppm",
    "formula": r"فرمول|\bformula\b|formula_|\bequation\b",
    "use": r"کاربرد|\buse[ds]?\b",
    "formula_id": r"\bformula_\d+_\d+\b",
    "formula_no": r"formula_\d+",
    "within": _whole("در|in"),
    "executable": r"\bformula_240_01\b",
    "sense": r"یعنی|چیه|چیست|معنایی\s+دارد|معنی|\bmean",
    "variable": r"متغیر|پارامتر|ورودی|چیزهایی\s+لازم|\bvariables?\b|\bparameters?\b|\binputs?\b",
    "inputs": rf"ahw_?\d*\s*{_SET}[\d.]+|\bt_?\d*\s*{_SET}[\d.]+|ahw\d+\s*[=:]?\s*[\d.]+",
    "default_run": r"(?:calculate|محاسبه\s*کن).*\bdefault\b",
    "formula_topic": r"فرمول|ahv|ارتعاش|محاسبه|\bvibration",
    "asks_what": r"چیست|چیه|چی\s|\bwhat is\b",
    "interprets": r"یعنی|مفهوم|توضیح|کاربرد|\bmean",
    "significance": r"تفسیر|وضعیت|یعنی چ|معنی|اهمیت|\binterpret",
    "result": r"ahv|فرمول|نتیجه|ارتعاش|formula_|\bresult",
    "formula_for": r"(?:رابطه|فرمول|\bformula\b).*(?:صفحه|ارتعاش|vibration|exposure|مواجهه)",
    "numbered": r"formula_\d+|شماره\s*\d+",
    "numbered_page": r"شماره\s*\d+.*صفحه\s*\d+|صفحه\s*\d+.*شماره\s*\d+",
    "calculates": r"ahv|محاسبه|حساب کن|mohasebe|compute|calculate",
    "content": r"با\s|with\s|=|default|ورودی",
    "ahv": r"ahv|محاسبه|حساب|\bcalculate\b|\bcompute\b",
    "relation_name": r"فرمول|formula_|رابطه",
    "identity": _MEANING + r"|معتبر|بازه",
    "bei": r"\bBEI\b|زیستی|بیولوژ",
    "oel": r"\bOEL\b|حد مجاز مواجهه",
    "noise": r"LAeq|صدا.*(?:یعنی|تعریف)|\bnoise\b.*\bmean|\bwhat is noise\b",
    "a8": r"A\(8\)|ارتعاش.*(?:یعنی|تعریف)|\bwhat is vibration\b",
    "cas_word": r"\bCAS\b",
    "cas_number": r"\d{2,7}\s*-\s*\d{2}\s*-\s*\d",
    "weight": r"وزن\s*مولکول|molecular\s*weight|\bMW\b",
    "source": r"منبع|صفحه|جدول|\bwhich page\b|\bsource\b",
    "short_term": r"\bSTEL\b|کوتاه.?مدت|۱۵ دقیقه",
    "only_stel": r"^STEL\s*\??$",
    "only_twa": r"^TWA\s*\??$",
    "only_cas": r"^CAS\s*\??$",
    "top": r"Ceiling|سقف|\bC\b",
    "mean": r"\bTWA\b|میانگین وزنی",
    "all": r"همه|تمام|TWA و STEL|\ball\b",
    "discusses": r"شامل|تعیین|می‌شود|میشود|کرده|معنا|توضیح|چرا|چگونه|تفاوت|یعنی|\bwhy\b|\bhow\b",
    "for_whom": r"برای [\p{L}\p{N}_]+ چنده",
    "recommend": r"توصیه|باید کرد|اقدام|\brecommend|\bshould\b",
    "prohibit": r"ممنوع|نباید|تشخیص|\bprohibit|\bforbid|\bmust not\b",
    "scope": r"کاربرد|حوزه|شهری|\bscope\b",
    "concept": r"تعریف|چیست|چیه|یعنی چ|معنا|\bwhat is\b|\bdefin",
    "explains": r"توضیح|چرا|چگونه|تفاوت|\bwhy\b|\bhow\b|\bexplain",
    "section": r"خلاصه|بخش|فصل|\bsection\b|\bchapter\b|\bsummar",
    "allowed": _whole("حد") + r"|چقدر|چنده|مجاز",
}

#: Decision, confidence (None: by relevance) and terms; words with @ are facts about the question and its session.
GATE_RULES = [
    ("BLOCK", 1.0, "@empty|@too_long|control"),
    ("BLOCK", 0.95, "injection"),
    ("BLOCK", 0.9, "abuse"),
    ("PASS", 0.95, "@session follow_up"),
    ("REJECT", 0.85, "off_domain"),
    ("PASS", None, "@relevant task"),
    ("PASS", 0.78, "strong task"),
    ("PASS", 0.72, "task !@under_20"),
    ("PASS", 0.7, "@session @under_60 task"),
    ("REJECT", 0.8, "@session @under_60"),
    ("CLARIFY", 0.6, "!@session @under_20 @irrelevant"),
    ("PASS", 0.5, "@any"),
]

#: Intent, confidence and terms; words with @ are slots.
INTENT_RULES = [
    ("CLARIFY.MISSING_CHEMICAL", 0.95, "@missing_name !@known"),
    ("CLARIFY.MISSING_LIMIT_TYPE", 0.95, "@missing_type"),
    ("CLARIFY.MISSING_EXPOSURE_VALUE", 0.95, "@missing_value"),
    ("CLARIFY.MISSING_DURATION", 0.95, "@missing_duration"),
    ("CLARIFY.MISSING_AGENT", 0.95, "@missing_agent"),
    ("CLARIFY.MISSING_CHEMICAL", 0.95, "@ambiguous"),
    ("GUARDRAIL.PROFESSIONAL_JUDGMENT", 0.88, "mood"),
    ("GUARDRAIL.PROFESSIONAL_JUDGMENT", 0.9, "judgment"),
    ("GUARDRAIL.UNSAFE_EXTRAPOLATION", 0.9, "long_shift limit|exposure"),
    ("GUARDRAIL.INVALID_INPUT", 0.9, "letters_for_number"),
    ("GUARDRAIL.INVALID_INPUT", 0.92, "bad_number"),
    ("GUARDRAIL.INVALID_INPUT", 0.92, "@cas !@valid_cas asks_valid"),
    ("GUARDRAIL.CONFLICTING_DATA", 0.88, "conflict"),
    ("GUARDRAIL.NO_DATA", 0.9, "placeholder|@unknown_name"),
    ("HYBRID.LOOKUP_AND_EXPLAIN", 0.88, "limit|how_much define and"),
    ("HYBRID.LOOKUP_COMPARE_EXPLAIN", 0.86, "compare twa stel|ceiling"),
    ("STRUCTURED.OEL.STEL_LOOKUP", 0.88, "amount relation fifteen !number_ppm @known"),
    ("HYBRID.LOOKUP_COMPARE_EXPLAIN", 0.85, "amount relation"),
    ("HYBRID.FORMULA_AND_EXPLAIN", 0.85, "formula use and"),
    ("FORMULA.VARIABLE.EXPLANATION", 0.86, "formula_id within sense"),
    ("FORMULA.VARIABLE.EXPLANATION", 0.82, "variable !inputs !default_run formula_no|formula_topic"),
    ("FORMULA.LOOKUP.BY_ID", 0.88, "formula_no asks_what !interprets"),
    ("FORMULA.INTERPRETATION", 0.85, "significance result"),
    ("FORMULA.LOOKUP.BY_DOMAIN", 0.82, "formula_for !numbered"),
    ("FORMULA.LOOKUP.BY_ID", 0.85, "numbered_page"),
    ("FORMULA.CALCULATION.UNSUPPORTED", 0.85, "inputs formula_id !executable"),
    ("FORMULA.CALCULATION.UNSUPPORTED", 0.85, "calculates formula_id !executable content !relation_name|!identity"),
    ("FORMULA.CALCULATION.VIBRATION_AHV", 0.9, "inputs"),
    ("CLARIFY.MISSING_EXPOSURE_VALUE", 0.85, "ahv !relation_name|!identity"),
    ("FORMULA.LOOKUP.BY_ID", 0.82, "formula_no"),
    ("SEMANTIC.EXPLANATION.CONCEPT", 0.78, "formula"),
    ("SEMANTIC.DEFINITION.BEI", 0.85, "bei"),
    ("SEMANTIC.EXPLANATION.CONCEPT", 0.82, "define two_types !@known"),
    ("SEMANTIC.DEFINITION.TWA", 0.9, "define twa"),
    ("SEMANTIC.DEFINITION.STEL", 0.9, "define stel"),
    ("SEMANTIC.DEFINITION.CEILING", 0.88, "define ceiling"),
    ("SEMANTIC.DEFINITION.OEL", 0.88, "define oel"),
    ("SEMANTIC.DEFINITION.NOISE", 0.85, "noise"),
    ("SEMANTIC.DEFINITION.VIBRATION", 0.85, "a8"),
    ("STRUCTURED.CHEMICAL.BY_NAME", 0.88, "cas_word asks_what !cas_number @name"),
    ("STRUCTURED.OEL.BY_CAS", 0.9, "@cas cas_number|cas_word"),
    ("STRUCTURED.CHEMICAL.MOLECULAR_WEIGHT", 0.9, "weight @known"),
    ("CLARIFY.MISSING_CHEMICAL", 0.88, "weight"),
    ("STRUCTURED.OEL.PROVENANCE", 0.85, "source @name"),
    ("SEMANTIC.EXPLANATION.CONCEPT", 0.78, "short_term !@known define"),
    ("CLARIFY.MISSING_CHEMICAL", 0.9, "short_term !@known"),
    ("STRUCTURED.OEL.STEL_LOOKUP", 0.9, "short_term"),
    ("STRUCTURED.OEL.TWA_LOOKUP", 0.92, "only_twa @name"),
    ("STRUCTURED.CHEMICAL.BY_NAME", 0.9, "only_cas @name"),
    ("SEMANTIC.EXPLANATION.CONCEPT", 0.78, "top limit !@known define"),
    ("CLARIFY.MISSING_CHEMICAL", 0.9, "top limit !@known"),
    ("STRUCTURED.OEL.CEILING_LOOKUP", 0.88, "top limit"),
    ("SEMANTIC.DEFINITION.TWA", 0.86, "mean !@known define"),
    ("CLARIFY.MISSING_CHEMICAL", 0.92, "mean !@known @under_25"),
    ("STRUCTURED.OEL.TWA_LOOKUP", 0.88, "mean"),
    ("STRUCTURED.OEL.ALL_LIMITS_LOOKUP", 0.88, "limit|how_much @name all"),
    ("STRUCTURED.OEL.TWA_LOOKUP", 0.88, "limit|how_much @name @limit_type"),
    ("STRUCTURED.OEL.ALL_LIMITS_LOOKUP", 0.86, "how_much @name"),
    ("CLARIFY.MISSING_LIMIT_TYPE", 0.85, "limit @name !discusses"),
    ("CLARIFY.MISSING_CHEMICAL", 0.92, "limit|how_much !@known @under_25"),
    ("CLARIFY.MISSING_LIMIT_TYPE", 0.9, "for_whom !@known"),
    ("SEMANTIC.REGULATION.RECOMMENDATION", 0.8, "recommend"),
    ("SEMANTIC.REGULATION.PROHIBITION", 0.8, "prohibit"),
    ("SEMANTIC.REGULATION.SCOPE", 0.78, "scope"),
    ("SEMANTIC.EXPLANATION.CONCEPT", 0.75, "concept"),
    ("SEMANTIC.EXPLANATION.CONCEPT", 0.72, "explains"),
    ("SEMANTIC.CONTEXT.SECTION", 0.75, "section"),
    ("CLARIFY.MISSING_CHEMICAL", 0.85, "allowed @under_20"),
    ("SEMANTIC.EXPLANATION.CONCEPT", 0.5, "@any"),
]
#: Who answers, by the beginning of the intent.
AGENTS = [("HYBRID.FORMULA", "formula,semantic"), ("HYBRID", "structured,semantic"), ("STRUCTURED", "structured"), ("FORMULA", "formula"), ("SEMANTIC", "semantic"), ("CLARIFY", "clarify")]
#: Longest question, and scores under which nothing is evidence.
LONGEST, SEMANTIC_LEAST = 2000, 0.42


def _cue(question: Column):
    return lambda word: question.rlike("(?i)" + CUES[word])


def gate(question: Column, in_session: Column | None = None) -> Column:
    """struct(decision, confidence): what may not pass, what follows up in a session, what is of the domain, and the rest."""
    q = F.trim(F.coalesce(question, F.lit("")))
    size, score = F.length(q), relevance(q)
    session = F.lit(False) if in_session is None else in_session
    facts = {
        "@empty": q == "",
        "@too_long": size > LONGEST,
        "@session": session,
        "@relevant": score >= 0.25,
        "@irrelevant": score < 0.1,
        "@under_20": size < 20,
        "@under_60": size < 60,
        "@any": F.lit(True),
    }
    cue = _cue(q)
    rules = [(holds(terms, lambda w: facts[w] if w in facts else cue(w)), F.struct(F.lit(d).alias("decision"), (F.least(F.lit(0.95), score + 0.5) if c is None else F.lit(c)).alias("confidence"))) for d, c, terms in GATE_RULES]
    return first_of(rules[:-1], rules[-1][1])


def relevance(question: Column) -> Column:
    """Words of the domain, and signs of it, for each distinct token of the question, at most 1."""
    low = latin_digits(F.lower(F.trim(question)))
    tokens = F.array_distinct(F.filter(F.split(low, r"[\s,;:.!?()\-–—/\\|]+"), lambda t: t != ""))
    hits = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in DOMAIN_WORDS])))
    signs = [(r"\b\d{2,7}-\d{2}-\d\b", 2), (r"(?i)\bformula_\d+_\d+\b", 2), (r"\b[A-Z][a-z]{2,}", 1), *((n, 1) for n in PERSIAN_NAMES)]
    more = sum([F.when(question.rlike(p), n).otherwise(0) for p, n in signs], F.lit(0))
    return F.when(F.size(tokens) > 0, F.least((hits + more) / F.size(tokens), F.lit(1.0))).otherwise(0.0)


def slots(question: Column) -> Column:
    """struct(cas, cas_valid, limit_type, value, unit, formula_id, name) read from a question; null where it has none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    cas = normalize_cas(question)
    measured = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(ppm|ppb|mg/m3|mg/m³)"
    return F.struct(
        cas.alias("cas"),
        F.when(cas.isNotNull(), is_valid_cas(cas)).alias("cas_valid"),
        F.upper(blank(F.regexp_extract(question, r"(?i)\b(twa|stel|ceiling)\b", 1))).alias("limit_type"),
        blank(F.regexp_extract(question, measured, 1)).try_cast("double").alias("value"),
        F.lower(blank(F.regexp_extract(question, measured, 2))).alias("unit"),
        blank(F.regexp_extract(question, r"(?i)\b(?:formula|equation)\s+([A-Z]?-?[0-9]+(?:[.-][0-9]+)*)", 1)).alias("formula_id"),
        blank(F.regexp_extract(question, r"(?i)\b(?:of|for|about)\s+([a-z][a-z0-9' -]{1,60}?)\s*(?:[?.,;]|$)", 1)).alias("name"),
    )


def intent(question: Column, cas: Column, name: Column, limit_type: Column | None = None, missing: Column | None = None, ambiguous: Column | None = None) -> Column:
    """struct(intent, confidence, agents): the first rule that holds.

    `missing` names slots that the session still lacks (name, limit_type, concentration,
    duration, other); `ambiguous` says that a name stands for several substances.
    """
    q = F.trim(F.coalesce(question, F.lit("")))
    lacks = lambda slot: F.lit(False) if missing is None else F.array_contains(missing, slot)
    facts = {
        "@cas": cas.isNotNull(),
        "@valid_cas": is_valid_cas(cas),
        "@name": name.isNotNull(),
        "@known": name.isNotNull() | cas.isNotNull(),
        "@unknown_name": F.contains(F.lower(name), F.lit("unknown")),
        "@limit_type": F.lit(False) if limit_type is None else limit_type.isNotNull(),
        "@missing_name": lacks("name"),
        "@missing_type": lacks("limit_type"),
        "@missing_value": lacks("concentration"),
        "@missing_duration": lacks("duration"),
        "@missing_agent": lacks("other"),
        "@ambiguous": F.lit(False) if ambiguous is None else ambiguous,
        "@under_20": F.length(q) < 20,
        "@under_25": F.length(q) < 25,
        "@any": F.lit(True),
    }
    cue = _cue(q)
    made = lambda label, confidence: F.struct(F.lit(label).alias("intent"), F.lit(confidence).alias("confidence"), F.lit(next((a for p, a in AGENTS if label.startswith(p)), "")).alias("agents"))
    rules = [(holds(terms, lambda w: facts[w] if w in facts else cue(w)), made(label, confidence)) for label, confidence, terms in INTENT_RULES]
    found = first_of(rules[:-1], rules[-1][1])
    return F.struct(found["intent"].alias("intent"), found["confidence"].alias("confidence"), F.filter(F.split(found["agents"], ","), lambda a: a != "").alias("agents"))


def query_type(question: Column, cas: Column, value: Column) -> Column:
    low = F.lower(question)
    return ordered_rules(
        [
            (low.rlike(r"\b(?:formula|equation|calculate)\b"), "formula"),
            (low.rlike(r"\b(?:table|row|column)\b"), "table"),
            (value.isNotNull(), "numeric"),
            (cas.isNotNull() | low.rlike(r"\b(?:twa|stel|ceiling)\b"), "structured"),
            (low.rlike(r"\b(?:what is|define|definition)\b"), "definition"),
            (low.rlike(r"\b(?:except|unless|exempt)"), "exception"),
            (low.rlike(r"\b(?:if|when|condition)\b"), "condition"),
        ],
        "narrative",
    )


def carry_slots(turns: DataFrame, session: str, turn: str, names: list[str]) -> DataFrame:
    """Each turn's own slots, or the latest known before it in the session."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumns({f"carried_{n}": F.coalesce(F.col(n), F.last(n, ignorenulls=True).over(w)) for n in names})


def follow_up(question: Column, turn: Column) -> Column:
    low = F.lower(question)
    return (turn > 0) & (low.rlike(r"^\s*(?:and|also|what about|how about|its?|that|those)\b") | (F.size(F.split(F.trim(low), r"\s+")) <= 4))


def hybrid_ratio(value: Column, limit: Column) -> Column:
    """struct(ratio, exceeds) of a concentration to its limit; null for no or a zero limit."""
    ratio = F.when(limit != 0, value / limit)
    return F.struct(ratio.alias("ratio"), (ratio > 1).alias("exceeds"))


def agents_with_semantic(agents: Column, wanted: Column) -> Column:
    return F.when(wanted, F.array_distinct(F.concat(agents, F.array(F.lit("semantic"))))).otherwise(agents)


def guardrail(intent_: Column, needs_clarification: Column, structured: Column, semantic_score: Column, reason: Column) -> Column:
    """pass, clarify, refuse or no_data, first rule first."""
    return ordered_rules(
        [
            (F.coalesce(needs_clarification, F.lit(False)) | F.startswith(intent_, F.lit("CLARIFY")), "clarify"),
            (F.startswith(intent_, F.lit("GUARDRAIL")), "refuse"),
            (F.startswith(intent_, F.lit("STRUCTURED")) & ~F.coalesce(structured, F.lit(False)) & F.coalesce(reason != "FOUND", F.lit(True)), "no_data"),
            (F.startswith(intent_, F.lit("SEMANTIC")) & (F.coalesce(semantic_score, F.lit(0.0)) < SEMANTIC_LEAST), "no_data"),
        ],
        "pass",
    )


def route(questions: DataFrame, text: str, in_session: Column | None = None) -> DataFrame:
    """Questions with gate, slots, intent, plan and type."""
    held = questions.withColumn("gate", gate(F.col(text), in_session)).withColumn("slots", slots(F.col(text)))
    held = held.withColumn("route", intent(F.col(text), F.col("slots.cas"), F.col("slots.name"), F.col("slots.limit_type")))
    return held.withColumn("query_type", query_type(F.col(text), F.col("slots.cas"), F.col("slots.value")))


def router_report(cases: DataFrame, expected: str, predicted: str, category: str) -> DataFrame:
    """Accuracy by category and over all."""
    return cases.rollup(category).agg(F.count("*").alias("cases"), F.round(F.avg((F.col(expected) == F.col(predicted)).cast("double")), 6).alias("accuracy"))
