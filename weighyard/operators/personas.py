"""The nine day personas and what belongs to them, as codes."""

from pyspark.sql import functions as F

from weighyard.functions.codes import text_array

# Persona -> headline colour, insight codes, focus codes.
PERSONAS = {
    "CRITICAL": ("danger",
                 ("INTAKE_FAR_BELOW", "DELIVERY_STUCK", "CHECK_MACHINES_AND_CREW"),
                 ("CLEAR_BOTTLENECKS", "TALK_TO_TRANSPORT_AND_FIELD", "URGENT_MACHINE_CHECK")),
    "EXCELLENT": ("success",
                  ("ABOVE_TARGET", "SMOOTH_TEAMWORK", "MACHINES_AT_CAPACITY"),
                  ("KEEP_HIGH_STANDARD", "RECORD_LESSONS", "PLAN_AHEAD")),
    "QUANTITY_PUSH": ("warning",
                      ("VOLUME_ON_TARGET", "FRESH_SHARE_FALLING", "BURNT_SHARE_RISING"),
                      ("RAISE_QUALITY", "SHARE_QUALITY_POLICY", "BALANCE_VOLUME_AND_QUALITY")),
    "QUALITY_FOCUS": ("primary",
                      ("FRESH_ABOVE_AVERAGE", "VOLUME_BELOW_TARGET", "GOOD_YARD_QUALITY"),
                      ("RAISE_VOLUME", "RAISE_TRANSPORT", "KEEP_QUALITY")),
    "VOLATILE_PERFORMANCE": ("info",
                             ("GOOD_BUT_UNEVEN", "CROWDED_HOURS", "IMPROVE_QUEUE"),
                             ("EVEN_INTAKE", "MANAGE_QUEUE", "TALK_TO_TRANSPORT")),
    "STABLE_RECOVERY": ("success",
                        ("BACK_TO_STANDARD", "RECOVERING", "FIXES_WORK"),
                        ("KEEP_GOING", "FOLLOW_DATA", "PREVENT_REPEAT")),
    "CONCERNING_TREND": ("warning",
                         ("TREND_FALLING", "SLOWING_DOWN", "ANALYSE_DEEPER"),
                         ("ANALYSE_TREND", "FIND_CAUSES_EARLY", "PLAN_PREVENTION")),
    "STEADY_PERFORMANCE": ("info",
                           ("ON_STANDARD", "PREDICTABLE", "GOOD_TEAMWORK"),
                           ("KEEP_STANDARD", "FIND_IMPROVEMENTS", "RAISE_EFFICIENCY")),
    "WEAK_START": ("warning",
                   ("SLOW_FIRST_HOURS", "CAN_STILL_IMPROVE", "PREPARE_FOR_RUSH"),
                   ("SPEED_UP", "PREPARE", "FIND_CAUSE_OF_SLOW_START")),
}

# Possible causes, for the four personas that have them.
ROOT_CAUSES = {
    "QUANTITY_PUSH": ("HASTY_CUTTING", "DROUGHT_ZONE", "INTAKE_CHECKS", "BURNT_HEAT_HANDLING"),
    "QUALITY_FOCUS": ("TRAFFIC_BOTTLENECK", "QUOTA_NOT_IN", "TRANSPORT_COORDINATION", "WEATHER"),
    "CRITICAL": ("HEAVY_RAIN", "TEAM_COMMUNICATION", "MACHINE_STOP", "SHIFT_CHANGE"),
    "VOLATILE_PERFORMANCE": ("ARRIVAL_CLUSTERS", "SCHEDULE_GAPS", "TRAFFIC_EPISODES", "QUEUE_SYSTEM"),
}

# Priority, risk and response time exist for two personas.
ATTENTION = {
    "CRITICAL": ("critical", "high", "immediate"),
    "EXCELLENT": ("low", "minimal", "normal"),
}


def persona_table(spark):
    """The catalogue as a nine-row dimension."""
    def word(value):
        return "CAST(NULL AS STRING)" if value is None else f"'{value}'"

    rows = []
    for name, (tone, insights, focus) in PERSONAS.items():
        priority, risk, response = ATTENTION.get(name, (None, None, None))
        rows.append(
            f"named_struct('persona', '{name}', 'tone', '{tone}', 'priority', {word(priority)}, "
            f"'risk_level', {word(risk)}, 'response_time', {word(response)}, 'insights', {text_array(insights)}, "
            f"'focus', {text_array(focus)}, 'root_causes', {text_array(ROOT_CAUSES.get(name, ()))})")
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def persona_profile(days):
    """Days with the catalogue entry of their persona. Nine rows, so broadcast is bounded."""
    return days.join(F.broadcast(persona_table(days.sparkSession)), "persona", "left")


def by_persona(values):
    """Lookup as an expression: the list of codes for the row's persona."""
    cases = " ".join(f"WHEN '{name}' THEN {text_array(codes)}" for name, codes in values.items())
    return f"CASE persona {cases} ELSE {text_array(())} END"
