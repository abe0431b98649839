"""Small employee tables with a planted reason to leave."""

from pyspark.sql import functions as F

from classweave.spec import BAD_RECORD, EMPLOYEE_DDL, employee_schema

RANGES = {
    "Age": (20, 60), "DailyRate": (100, 1400), "DistanceFromHome": (1, 29),
    "MonthlyIncome": (2000, 19000), "MonthlyRate": (2300, 26300),
    "HourlyRate": (30, 100), "PercentSalaryHike": (11, 25),
    "PerformanceRating": (3, 4), "EmployeeCount": (1, 1),
    "StandardHours": (80, 80), "TotalWorkingYears": (1, 31),
    "YearsAtCompany": (0, 25),
}
CATEGORIES = {
    "BusinessTravel": ["Non-Travel", "Travel_Frequently", "Travel_Rarely"],
    "Department": ["Human Resources", "Research & Development", "Sales"],
    "EducationField": ["Life Sciences", "Marketing", "Medical", "Other"],
    "Gender": ["Female", "Male"],
    "JobRole": ["Manager", "Research Scientist", "Sales Executive"],
    "MaritalStatus": ["Divorced", "Married", "Single"],
    "OverTime": ["No", "Yes"],
    "Over18": ["Y"],
}


def draw(name, salt=0):
    return F.abs(F.xxhash64("id", F.lit(name), F.lit(salt)))


def employees(spark, rows, salt=0, partitions=2):
    """One row per employee; long hours for little pay make people leave."""
    base = spark.range(0, rows, 1, partitions)
    columns = {}
    for field in employee_schema().fields:
        name = field.name
        if name == "EmployeeNumber":
            value = F.col("id").cast("int")
        elif name in CATEGORIES:
            items = F.array(*(F.lit(c) for c in CATEGORIES[name]))
            value = F.get(items, (draw(name, salt) % len(CATEGORIES[name])).cast("int"))
        elif name == "Attrition":
            value = F.lit(None).cast("string")
        else:
            low, high = RANGES.get(name, (1, 4))
            value = (F.lit(low) + draw(name, salt) % (high - low + 1)).cast("int")
        columns[name] = value
    table = base.select(*(c.alias(n) for n, c in columns.items()))
    leaving = (F.col("OverTime") == "Yes") & (F.col("MonthlyIncome") < 8000)
    return table.withColumn("Attrition", F.when(leaving, "Yes").otherwise("No"))


__all__ = ["BAD_RECORD", "EMPLOYEE_DDL", "employees"]
