"""Recommendations and advice as codes; needs persona, patterns and efficiency."""

from weighyard.functions.codes import code_list, collect_findings, text_array
from weighyard.functions.layers import add
from weighyard.operators.rules import FRESH, HOURS, T, V, day_part

# The steps that come with each kind of recommendation.
ACTIONS = {
    "VOLUME": ("CHECK_TRUCKS_UNDERWAY", "TALK_TO_FIELD_TEAM", "ADJUST_QUEUE_PLAN"),
    "QUALITY": ("REVIEW_INTAKE_CRITERIA", "REDUCE_BURNT_AND_TRASH", "FIND_LOW_QUALITY_ZONES"),
    "STABILITY": ("STUDY_HOURLY_DATA", "SPREAD_ARRIVALS", "FLEXIBLE_QUEUE_CALLS"),
    "IMPROVE": ("SHORT_TEAM_MEETING", "LOOK_FOR_TRENDS", "PLAN_TOMORROW"),
    "TIME_ADVICE": ("ADJUST_PLAN", "COORDINATE_TEAMS", "FOLLOW_RESULTS"),
    "RISK": ("EMERGENCY_MEETING", "CHECK_HISTORY", "PREPARE_BACKUP_PLAN", "INFORM_MANAGEMENT"),
    "SEASON": ("ESTIMATE_REMAINING", "PLAN_LAST_TRANSPORT", "PREPARE_MAINTENANCE", "RECORD_LESSONS"),
    "QUALITY_CONTROL": ("FIND_QUALITY_CAUSES", "CHECK_BURNT_HANDLING", "TIGHTEN_CRITERIA", "TRAIN_TEAM"),
    "WEEKEND": ("CHECK_WEEKEND_VOLUME", "STAFF_AND_MACHINES", "FINISH_TRANSPORT", "PLAN_MONDAY"),
    "EFFICIENCY": ("FIND_WEAK_POINTS", "IMPROVE_QUEUE", "RAISE_FIELD_TRANSPORT", "TRAIN_SKILLS"),
}
NEXT_CYCLE_ACTIONS = ("REVIEW_ROOT_CAUSE", "UPDATE_NEXT_PLAN", "SHARE_IMPROVEMENTS")




def _recommend(condition, priority, category, detail=None):
    shown = "CAST(NULL AS STRING)" if detail is None else f"'{detail}'"
    return (f"IF({condition}, named_struct('priority', '{priority}', 'category', '{category}', 'detail', {shown}, "
            f"'next_cycle', false, 'actions', {text_array(ACTIONS[category])}), NULL)")


_BEHIND = f"{T} < {V} * 0.8D"
_LOW_FRESH = f"{FRESH} < 80"


def adaptive_rules(part):
    """(condition, code) of the advice that depends on the part of the day."""
    urgent = "persona IN ('WEAK_START', 'CRITICAL')"
    slow = "coalesce(volume_eff < 90, false)"
    timed = {
        "morning": [(urgent, "MORNING_EMERGENCY_MEETING"), (f"NOT {urgent}", "MORNING_SET_TARGETS")],
        "afternoon": [(slow, "AFTERNOON_PUSH_TRANSPORT"), (f"NOT {slow}", "AFTERNOON_KEEP_STANDARD")],
        "evening": [("true", "EVENING_REVIEW_AND_PLAN")],
        "night": [],
    }[part]
    return timed + [(_BEHIND, "FIND_CAUSES_FOR_TOMORROW"), (_LOW_FRESH, "STRESS_QUALITY_CONTROL")]


def recommendations(days, as_of_hour):
    """Persona base first, then time of day (current days only), patterns, efficiency.

    For past days (`mode`) a critical item becomes medium, the item is marked for the next
    cycle and keeps its first step before the planning steps.
    """
    special = "persona IN ('CRITICAL', 'QUALITY_FOCUS', 'QUANTITY_PUSH', 'VOLATILE_PERFORMANCE')"
    items = collect_findings(
        _recommend("persona IN ('CRITICAL', 'QUALITY_FOCUS')", "high", "VOLUME"),
        _recommend("persona = 'QUANTITY_PUSH'", "high", "QUALITY"),
        _recommend("persona = 'VOLATILE_PERFORMANCE'", "medium", "STABILITY"),
        _recommend(f"NOT {special}", "low", "IMPROVE"),
        *[_recommend(f"mode <> 'historical' AND {condition}", "medium", "TIME_ADVICE", code)
          for condition, code in adaptive_rules(day_part(as_of_hour))],
        _recommend("anomaly_score > 0.7", "critical", "RISK"),
        _recommend("season = 'late_season'", "medium", "SEASON"),
        _recommend("quality_pattern = 'declining'", "high", "QUALITY_CONTROL"),
        _recommend("week_part = 'week_end'", "medium", "WEEKEND"),
        _recommend("volume_eff < 80", "high", "EFFICIENCY"),
    )
    later = f"""transform(_items, r -> named_struct(
        'priority', IF(r.priority = 'critical', 'medium', r.priority), 'category', r.category, 'detail', r.detail,
        'next_cycle', true, 'actions', concat(slice(r.actions, 1, 1), {text_array(NEXT_CYCLE_ACTIONS)})))"""
    listed = add(days, {"_items": items})
    return add(listed, {"recommendations": f"IF(mode = 'historical', {later}, _items)"}).drop("_items")


def advice(days, as_of_hour):
    """Six coded lists for the day as seen at `as_of_hour`."""
    part = day_part(as_of_hour)
    morning, afternoon, evening = (str(part == p).lower() for p in ("morning", "afternoon", "evening"))
    share = f"IF({T} > 0 AND {V} > 0, {T} / {V}, NULL)"
    early, late = f"{morning} AND {HOURS} < 4", f"{afternoon} AND {HOURS} >= 8"
    due = f"({HOURS} / 24 * {V})"
    far_behind = f"{T} < {V} * 0.6D"
    return add(days, {
        "practical": code_list(
            (f"{share} < 0.7", "IMPROVE_TRANSPORT_AND_QUEUE"), (f"{share} > 1.3", "KEEP_HIGH_EFFICIENCY"),
            (early, "MORNING_PREPARATION"), (late, "AFTERNOON_CATCH_UP"), (evening, "EVENING_LESSONS"),
            ("persona = 'VOLATILE_PERFORMANCE'", "QUEUE_AGAINST_SWINGS"),
            ("persona = 'QUALITY_FOCUS'", "KEEP_QUALITY_RAISE_VOLUME"),
            ("persona = 'QUANTITY_PUSH'", "IMPROVE_INTAKE_CHECKS"),
        ),
        "actionable": code_list(
            (_BEHIND, "MEET_TRANSPORT_TEAM"), (_BEHIND, "CHECK_MISSING_TRUCKS"),
            (morning, "SET_TARGETS"), (morning, "CHECK_MACHINES"),
            (f"{afternoon} AND {far_behind}", "PUSH_TRANSPORT"),
            (f"{afternoon} AND NOT {far_behind}", "KEEP_STANDARD"),
            (evening, "SUMMARISE_AND_PLAN"),
            ("persona = 'CRITICAL'", "CALL_TEAM_NOW"), ("persona = 'EXCELLENT'", "RECORD_SUCCESS"),
            ("persona = 'WEAK_START'", "PREPARE_FOR_RISE"),
        ),
        "learning": code_list(
            (f"{share} < 0.7", "TRANSPORT_PLANNING_FAILED"), (f"{share} > 1.3", "RECORD_SUCCESS_FACTORS"),
            ("anomaly_score > 0.7", "DETECT_EARLY"),
            ("persona = 'VOLATILE_PERFORMANCE'", "EVEN_INTAKE_IS_HARD"),
            ("persona = 'QUALITY_FOCUS'", "QUALITY_WITH_VOLUME"),
            ("persona = 'STABLE_RECOVERY'", "SYSTEMATIC_FIXES"),
        ),
        "contextual": code_list(
            (f"{early} AND {T} < {V} * 0.2D", "SLOW_MORNING"),
            (f"{early} AND NOT {T} < {V} * 0.2D", "GOOD_MORNING"),
            (f"{late} AND {T} < {due} * 0.8D", "AFTERNOON_BEHIND"),
            (f"{late} AND {T} > {due} * 1.2D", "AFTERNOON_AHEAD"),
            (f"{evening} AND {HOURS} >= 16", "DAY_NEARLY_DONE"),
            (f"{T} > {V} * 1.2D", "VOLUME_ABOVE_TARGET"), (_LOW_FRESH, "FRESH_BELOW_STANDARD"),
        ),
        "proactive": code_list(
            (_BEHIND, "FIND_CAUSES_FOR_TOMORROW"), (f"{HOURS} >= 12 AND {T} < {V} * 0.9D", "PLAN_COMPENSATION"),
            (_LOW_FRESH, "IMPROVE_QUALITY_PROCESS"),
        ),
        "adaptive": code_list(*adaptive_rules(part)),
    })
