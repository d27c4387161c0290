"""System prompts: parts, thresholds, cuts and users about whom nothing is known."""

from skein.operators import prompts

PROFILE = "user_id long, domain string, domain_confidence double, language string, formality double, verbosity double, topics array<string>, patterns array<string>, task_types array<string>"
COMPETENCE = "user_id long, topic string, level string, place int"


def test_prompts_of_all_kinds(spark):
    many = list("abcdefg")
    profiles = spark.createDataFrame([(1, "data_science", 0.5, "es", 0.9, 0.1, many, many, many), (2, "unknown", 0.9, "es", 0.5, 0.5, [], [], []), (3, "law", 0.05, "en", 0.1, 0.9, None, None, None), (4, None, None, None, None, None, None, None, None)], PROFILE)
    competence = spark.createDataFrame([(1, f"t{k}", "Expert" if k % 2 else "Competent", 20 - k) for k in range(14)] + [(2, "x", "Novice", 1), (3, "only", "Competent", 1)], COMPETENCE)
    asked = spark.createDataFrame([(u, t) for u in (1, 2, 3, 4, 5) for t in ("architecture", "general", "other", None)], "user_id long, task string")
    got = {(r.user_id, r.task): r.prompt for r in prompts.system_prompts(asked, profiles, competence).collect()}
    able = "Expert in: t13, t11, t9, t7, t5. Competent in: t12, t10, t8, t6, t4."
    who = "You are assisting a data science professional. Respond in es."
    assert got[1, "architecture"] == f"Task: architecture. Explain trade-offs. Consider scalability and maintainability. {who} Tech focus: a, b, c, d, e. a. b. c. d. e. Common tasks: a, b, c, d, e. {able}"
    assert got[1, "general"] == f"{who} {able}"
    assert got[1, "other"] == got[1, None] == f"You are assisting a data science professional. a. b. c. d. e. Respond in es. {able}"
    assert got[2, "general"] == got[4, "general"] == got[5, "general"] == prompts.ANYONE and got[3, "general"] == f"{prompts.ANYONE} Competent in: only."
    assert got[5, "other"] == f"{prompts.ANYONE} Adapt your responses to the user's needs."
    plain = {(r.user_id, r.task): r.prompt for r in prompts.system_prompts(asked, profiles, competence, personal=False).collect()}
    assert plain[1, "general"] == prompts.ANYONE == plain[5, None] and plain[2, "architecture"].startswith("Task: architecture.")
    style = {r.user_id: r.s for r in profiles.select("user_id", prompts.fragment("style").alias("s")).collect()}
    assert style == {1: "Use formal tone. Be concise.", 2: "", 3: "Use casual tone. Be detailed.", 4: ""}
    assert profiles.select(prompts.fragment("decisions").alias("s")).distinct().collect()[0].s == ""
