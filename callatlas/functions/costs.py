"""Usage estimates and costs in rupees, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rupees per hour, per million tokens, per 10,000 characters, per minute, per call.
STT_HOUR, STT_DIARIZED_HOUR = 30.0, 45.0
LLM_IN, LLM_CACHED, LLM_OUT = 29.28, 10.98, 73.20
TTS_10K, TTS_V3_10K = 15.0, 30.0
TELEPHONY_MINUTE, PLATFORM_MINUTE = 0.36, 3.50
HUMAN_CALL = 42.0
# Characters to a token, tokens of the standing prompt.
CHARS_PER_TOKEN, PROMPT_TOKENS = 4, 1400


def checked(quantity: Column, name: str) -> Column:
    """The quantity; below zero it raises."""
    return F.when(quantity < 0, F.raise_error(F.lit(f"negative {name}")).cast("double")).otherwise(quantity)


def estimated(agent_chars: Column, caller_chars: Column, turns: Column) -> dict[str, Column]:
    """Usage of a conversation that brings none."""
    least = F.greatest(F.lit(1), turns)
    return {
        "tts_characters": agent_chars,
        "out_tokens": F.greatest(F.lit(1), F.floor(agent_chars / CHARS_PER_TOKEN)),
        "cached_tokens": PROMPT_TOKENS * F.greatest(F.lit(0), turns - 1),
        "in_tokens": PROMPT_TOKENS + F.floor(caller_chars / CHARS_PER_TOKEN),
        "turns": least,
    }


def components(audio_s: Column, telephony_s: Column, tts: Column, fresh: Column, cached: Column, out: Column, diarized: bool = False, tts_v3: bool = False) -> dict[str, Column]:
    return {
        "stt": checked(audio_s, "audio seconds") / 3600 * (STT_DIARIZED_HOUR if diarized else STT_HOUR),
        "llm_in": checked(fresh, "tokens") / 1e6 * LLM_IN,
        "llm_cached": checked(cached, "tokens") / 1e6 * LLM_CACHED,
        "llm_out": checked(out, "tokens") / 1e6 * LLM_OUT,
        "tts": checked(tts, "characters") / 1e4 * (TTS_V3_10K if tts_v3 else TTS_10K),
        "telephony": checked(telephony_s, "telephony seconds") / 60 * TELEPHONY_MINUTE,
    }


def platform(audio_s: Column, telephony_s: Column) -> Column:
    """On a managed platform."""
    return checked(audio_s, "audio seconds") / 60 * PLATFORM_MINUTE + checked(telephony_s, "telephony seconds") / 60 * TELEPHONY_MINUTE


def savings_percent(cost: Column, human: float = HUMAN_CALL) -> Column:
    if human <= 0:
        raise ValueError("the human cost per call has to be above zero")
    return (1 - cost / human) * 100
