"""Column lists, struct types and fixed lookup values shared by every module."""

from pyspark.sql import types as T

STRINGS = ("source_dataset", "employee_id", "job_role", "work_mode", "company_size")

# ---------------------------------------------------------------- fixed values
# Names, order, labels and texts below are part of the data contract: results
# are only right when they are spelled exactly like this.

CANONICAL = (
    "source_dataset",
    "employee_id",
    "work_hours_per_week",
    "overtime_hours",
    "meetings_per_day",
    "deadlines_missed",
    "experience_years",
    "job_role",
    "work_mode",
    "job_satisfaction",
    "manager_support",
    "work_life_balance",
    "sleep_hours",
    "physical_activity_days",
    "stress_level",
    "mental_fatigue_score",
    "strain_score",
    "caffeine_intake",
    "company_size",
    "screen_time_hours",
    "social_support_score",
)

# Metrics that get a missing-value flag and a role-median fill.
TRACKED = (
    "work_hours_per_week",
    "overtime_hours",
    "meetings_per_day",
    "deadlines_missed",
    "experience_years",
    "job_satisfaction",
    "manager_support",
    "work_life_balance",
    "sleep_hours",
    "physical_activity_days",
    "mental_fatigue_score",
    "caffeine_intake",
    "screen_time_hours",
    "social_support_score",
)

MODEL_CATEGORICAL = ("company_size", "job_role", "work_mode")
MODEL_NUMERIC = (
    "caffeine_intake",
    "deadlines_missed",
    "experience_years",
    "job_satisfaction",
    "manager_support",
    "meetings_per_day",
    "overtime_hours",
    "physical_activity_days",
    "screen_time_hours",
    "sleep_hours",
    "social_support_score",
    "stress_level",
    "work_hours_per_week",
    "work_life_balance",
)
MODEL_FEATURES = tuple(sorted(MODEL_CATEGORICAL + MODEL_NUMERIC))

ENGINEERED = ("workload_index", "wellness_score", "support_index", "meeting_load")

# Fields an uploaded roster must carry.
REQUIRED_UPLOAD = (
    "deadlines_missed",
    "experience_years",
    "job_role",
    "meetings_per_day",
    "overtime_hours",
    "work_hours_per_week",
    "work_mode",
)

# First present name wins.
ALIASES = {
    "city": ("city", "employee_location", "location"),
    "state": ("state", "province", "region"),
    "gender": ("gender", "sex"),
    "employee_id": ("employeeid", "employee_id", "emp_id", "empid"),
}

TARGET = "strain_score"

# Headers, labels and file names of foreign data, as their files spell them. Everything
# else in this library uses the neutral names on the right.
FOREIGN_HEADERS = {"burnout_score": "strain_score", "burnout_level": "strain_level"}
SURVEY_TARGET = "BurnoutLevel"
SOURCE_LABELS = {
    "tech": "tech_mental_health_burnout",
    "employees": "are_employees_burning_out",
    "survey": "mental_health_workplace_survey",
    "ordinal": "train_csv_small",
}
LAYOUT_FILES = {
    "tech": "tech_mental_health_burnout.csv",
    "employees": "Are Your Employees Burning Out.csv",
    "survey": "mental_health_workplace_survey.csv",
    "ordinal": "train.csv",
}
# Columns that may hold an id, in the order in which they are tried.
ID_COLUMNS = ("employee_id", "employeeid", "emp_id", "empid", "EmployeeID")
LEAKING = ("strain_level",)
SENSITIVE = (
    "age",
    "gender",
    "has_therapy",
    "seeks_professional_help",
    "anxiety_score",
    "depression_score",
)
PIPELINE_EXCLUDED = (
    "strain_score",
    "employee_segment",
    "source_dataset",
    "employee_id",
    "mental_fatigue_score",
    "stress_level",
)
REQUIRED_TRAINING = ("strain_level", "strain_score", "stress_level", "work_hours_per_week")

WORK_MODES = {
    "Hybrid": "Hybrid",
    "Remote": "Remote",
    "Onsite": "Onsite",
    "On-site": "Onsite",
    "Home": "Remote",
    "Office": "Onsite",
}

HOURS_BANDS = (
    (0, 35, "Undertime (<35h)"),
    (35, 40, "Standard (35–40h)"),
    (40, 50, "Overtime (41–50h)"),
    (50, 60, "Extended (51–60h)"),
    (60, 999, "Extreme (>60h)"),
)

BANDS = ("Low", "Moderate", "Elevated")
MODERATE_FROM = 2.5
DEFAULT_THRESHOLD = 4.5
RISK_QUANTILE = 0.90
SEED = 42

FIVE_BANDS = (
    (7.5, "CRITICAL"),
    (5.5, "HIGH"),
    (4.5, "ELEVATED"),
    (2.5, "MODERATE"),
)

ADVICE = (
    (
        6.0,
        (
            "Immediate HR intervention recommended",
            "Schedule 1:1 with manager this week",
            "Enforce minimum 7h sleep goal",
            "Encourage physical activity schedule",
        ),
    ),
    (
        4.5,
        (
            "Monitor employee closely over next 30 days",
            "Check-in meeting with manager",
            "Reduce overtime if possible",
        ),
    ),
    (
        None,
        (
            "Employee wellbeing appears satisfactory",
            "Continue regular check-ins",
        ),
    ),
)

# Weight of each metric in the linear strain index, and the metric's divisor.
STRAIN_WEIGHTS = (
    ("stress_level", 0.30, 1.0),
    ("work_hours_per_week", 0.18, 8.0),
    ("overtime_hours", 0.15, 2.5),
    ("meetings_per_day", 0.10, 1.0),
    ("deadlines_missed", 0.08, 0.6),
    ("screen_time_hours", 0.06, 1.6),
    ("sleep_hours", -0.12, 1.0),
    ("job_satisfaction", -0.10, 1.0),
    ("manager_support", -0.09, 1.0),
    ("work_life_balance", -0.08, 1.0),
    ("physical_activity_days", -0.05, 0.7),
)

# metric, driver name, smallest gap reported, gap that counts as strength 1, unit
DRIVERS = (
    ("overtime_hours", "Overtime Load", 0.3, 3.0, "h/wk"),
    ("meetings_per_day", "Meeting Density", 0.3, 2.0, " mtgs/d"),
    ("work_hours_per_week", "Extended Hours", 0.8, 5.0, "h/wk"),
    ("deadlines_missed", "Deadline Friction", 0.2, 1.0, " missed"),
    ("stress_level", "Elevated Stress", 0.3, 2.0, " pts"),
)
NO_DRIVER = ("Balanced Profile", "Low friction")

POLICIES = (
    {
        "id": "overtime_cap",
        "title": "Overtime Hours Guardrail",
        "badge": "High Leverage",
        "description": "Cap individual overtime at maximum 4 hours/week and prevent weekend spillover.",
        "action": "Cap overtime ≤ 4h/week",
        "effort": "Low Effort",
        "caps": {"overtime_hours": 4.0},
        "preset": {"sl-overtime": 4},
    },
    {
        "id": "meeting_detox",
        "title": "Meeting Detox (Focus Blocks)",
        "badge": "Cultural Shift",
        "description": "Cap daily meetings at maximum 3 per day; introduce dedicated no-meeting blocks.",
        "action": "Cap meetings ≤ 3/day",
        "effort": "Medium Effort",
        "caps": {"meetings_per_day": 3.0},
        "preset": {"sl-meetings": 3},
    },
    {
        "id": "standard_workweek",
        "title": "Workweek Workload Normalization",
        "badge": "Policy Cap",
        "description": "Limit total weekly workload to ≤ 42 hours across salaried departments.",
        "action": "Workweek ≤ 42h",
        "effort": "Policy Shift",
        "caps": {"work_hours_per_week": 42.0},
        "preset": {"sl-hours": 42},
    },
    {
        "id": "combined_policy",
        "title": "Comprehensive Wellbeing Policy",
        "badge": "Maximum Impact",
        "description": "Simultaneous implementation: 4h overtime guardrail combined with 3-meeting daily ceiling.",
        "action": "Overtime ≤ 4h + Meetings ≤ 3/day",
        "effort": "Combined Policy",
        "caps": {"overtime_hours": 4.0, "meetings_per_day": 3.0},
        "preset": {"sl-overtime": 4, "sl-meetings": 3},
    },
)

SEGMENTS = (
    "Overloaded (At Risk)",
    "Healthy & Balanced",
    "Disengaged",
    "Moderate / Transitioning",
)

CORRELATED = (
    "stress_level",
    "work_hours_per_week",
    "overtime_hours",
    "meetings_per_day",
    "sleep_hours",
    "job_satisfaction",
    "manager_support",
    "work_life_balance",
    "workload_index",
    "wellness_score",
    "strain_score",
)

METADATA_FIELDS = (
    "employee_id",
    "employeeid",
    "emp_id",
    "empid",
    "EmployeeID",
    "gender",
    "sex",
    "age",
    "city",
    "state",
    "State",
    "employee_location",
    "location",
    "job_role",
    "work_mode",
    "experience_years",
    "company_size",
)

ROSTER = (
    "id",
    "role",
    "mode",
    "city",
    "state",
    "gender",
    "hours",
    "stress",
    "overtime",
    "experience",
    "score",
    "prob",
    "band",
)

LIMITATIONS = (
    "Trained on public proxy data: check against data of your own people, collected with consent.",
    "Bands describe groups statistically; they are no diagnosis and no ground for measures against a person.",
    "Records carry no time, so nothing here forecasts a development.",
)

CITY_STATES = {
    "new delhi": "Delhi",
    "delhi": "Delhi",
    "noida": "Uttar Pradesh",
    "ghaziabad": "Uttar Pradesh",
    "gurugram": "Haryana",
    "faridabad": "Haryana",
    "mumbai": "Maharashtra",
    "pune": "Maharashtra",
    "nagpur": "Maharashtra",
    "nashik": "Maharashtra",
    "thane": "Maharashtra",
    "aurangabad": "Maharashtra",
    "bengaluru": "Karnataka",
    "bangalore": "Karnataka",
    "hubballi": "Karnataka",
    "mysuru": "Karnataka",
    "mangaluru": "Karnataka",
    "belagavi": "Karnataka",
    "chennai": "Tamil Nadu",
    "coimbatore": "Tamil Nadu",
    "salem": "Tamil Nadu",
    "tiruchirappalli": "Tamil Nadu",
    "madurai": "Tamil Nadu",
    "hyderabad": "Telangana",
    "warangal": "Telangana",
    "nizamabad": "Telangana",
    "karimnagar": "Telangana",
    "ahmedabad": "Gujarat",
    "surat": "Gujarat",
    "vadodara": "Gujarat",
    "rajkot": "Gujarat",
    "gandhinagar": "Gujarat",
    "jaipur": "Rajasthan",
    "jodhpur": "Rajasthan",
    "udaipur": "Rajasthan",
    "kota": "Rajasthan",
    "ajmer": "Rajasthan",
    "bikaner": "Rajasthan",
    "lucknow": "Uttar Pradesh",
    "kanpur": "Uttar Pradesh",
    "agra": "Uttar Pradesh",
    "varanasi": "Uttar Pradesh",
    "meerut": "Uttar Pradesh",
    "allahabad": "Uttar Pradesh",
    "prayagraj": "Uttar Pradesh",
    "kolkata": "West Bengal",
    "howrah": "West Bengal",
    "durgapur": "West Bengal",
    "siliguri": "West Bengal",
    "asansol": "West Bengal",
    "panipat": "Haryana",
    "rohtak": "Haryana",
    "hisar": "Haryana",
    "ambala": "Haryana",
    "ludhiana": "Punjab",
    "amritsar": "Punjab",
    "jalandhar": "Punjab",
    "patiala": "Punjab",
    "chandigarh": "Punjab",
    "kochi": "Kerala",
    "thiruvananthapuram": "Kerala",
    "kozhikode": "Kerala",
    "thrissur": "Kerala",
    "kollam": "Kerala",
    "bhopal": "Madhya Pradesh",
    "indore": "Madhya Pradesh",
    "jabalpur": "Madhya Pradesh",
    "gwalior": "Madhya Pradesh",
    "ujjain": "Madhya Pradesh",
    "ranchi": "Jharkhand",
    "jamshedpur": "Jharkhand",
    "dhanbad": "Jharkhand",
    "bhubaneswar": "Odisha",
    "cuttack": "Odisha",
    "rourkela": "Odisha",
    "patna": "Bihar",
    "gaya": "Bihar",
    "muzaffarpur": "Bihar",
    "bhagalpur": "Bihar",
    "guwahati": "Assam",
    "silchar": "Assam",
    "dibrugarh": "Assam",
    "jorhat": "Assam",
    "dehradun": "Uttarakhand",
    "haridwar": "Uttarakhand",
    "haldwani": "Uttarakhand",
    "panaji": "Goa",
    "margao": "Goa",
    "vasco da gama": "Goa",
    "raipur": "Chhattisgarh",
    "bilaspur": "Chhattisgarh",
    "durg": "Chhattisgarh",
    "visakhapatnam": "Andhra Pradesh",
    "vijayawada": "Andhra Pradesh",
    "guntur": "Andhra Pradesh",
    "shimla": "Himachal Pradesh",
    "manali": "Himachal Pradesh",
    "srinagar": "Jammu & Kashmir",
    "jammu": "Jammu & Kashmir",
}
# ------------------------------------------------------------ end fixed values


def _struct(columns, strings):
    return T.StructType(
        [T.StructField(c, T.StringType() if c in strings else T.DoubleType()) for c in columns]
    )


CANONICAL_TYPE = _struct(CANONICAL, STRINGS)

RAW_TYPES = {
    "tech": _struct(
        [{v: k for k, v in FOREIGN_HEADERS.items()}.get(c, c) for c in CANONICAL
         if c not in ("source_dataset", "employee_id", "mental_fatigue_score")],
        STRINGS,
    ),
    "employees": _struct(
        ["Employee ID", "Resource Allocation", "Designation", "WFH Setup Available",
         "Mental Fatigue Score", "Burn Rate"],
        ("Employee ID", "WFH Setup Available"),
    ),
    "survey": _struct(
        ["EmployeeID", "WorkHoursPerWeek", "YearsAtCompany", "JobRole", "RemoteWork",
         "JobSatisfaction", "ManagerSupportScore", "WorkLifeBalanceScore", "SleepHours",
         "PhysicalActivityHrs", "StressLevel", SURVEY_TARGET, "TeamSize"],
        ("EmployeeID", "JobRole", "RemoteWork"),
    ),
    "ordinal": _struct(
        ["Employee_Id", "Avg_Working_Hours_Per_Day", "Work_From", "Job_Satisfaction",
         "Manager_Support", "Work_Life_Balance", "Sleeping_Habit", "Exercise_Habit", "Stress_Level"],
        ("Employee_Id", "Work_From", "Job_Satisfaction", "Manager_Support",
         "Work_Life_Balance", "Sleeping_Habit", "Exercise_Habit"),
    ),
}

# starting centres of the step that is checked in SQL: workload, wellness, score
KMEANS_STARTS = (
    ((30.0, 40.0, 3.0), (50.0, 60.0, 5.0), (70.0, 50.0, 7.0), (40.0, 70.0, 2.0)),
    ((20.0, 50.0, 6.0), (60.0, 50.0, 4.0), (45.0, 55.0, 5.0)),
)

# ids of the single lookups that are checked in SQL, as the customers table spells them
FIND_IDS = ("Ex1", "ALT2", "Ex3", " em4", "Ex1 ", "ALT2 ", "Ex3 ", " em4 ", "ALT6 ", " em8 ", "ALT10 ", "Ex99999999 ")
