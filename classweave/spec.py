"""Column roles and declared schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD_RECORD = "_bad"


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns play which part; passed to every learning operator.

    ``key`` names the columns that identify a row. They feed the hash sample,
    so they must hold integers or strings.
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    label: str
    key: tuple[str, ...]
    negative: str = "No"
    positive: str = "Yes"

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def columns(self) -> list[str]:
        """Every column training reads, each once."""
        return list(dict.fromkeys((*self.key, *self.inputs, self.label)))

    def label_column(self) -> Column:
        """0.0 / 1.0 with the mapping pinned, whatever the class frequencies."""
        text = F.col(self.label)
        return (
            F.when(text == self.negative, F.lit(0.0))
            .when(text == self.positive, F.lit(1.0))
        )

    def with_label(self, df: DataFrame, name: str = "label") -> DataFrame:
        return df.withColumn(name, self.label_column())


_TYPES = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "TIMESTAMP": T.TimestampType(),
}


def parse_schema(ddl: str) -> T.StructType:
    """``name TYPE, ...`` as nullable fields; needs no running session."""
    pairs = (item.split() for item in ddl.split(","))
    return T.StructType([T.StructField(n, _TYPES[kind]) for n, kind in pairs])


# The employee record, its order, types and column roles.
EMPLOYEE_DDL = """
    Age INT, Attrition STRING, BusinessTravel STRING, DailyRate INT,
    Department STRING, DistanceFromHome INT, Education INT,
    EducationField STRING, EmployeeCount INT, EmployeeNumber INT,
    EnvironmentSatisfaction INT, Gender STRING, HourlyRate INT,
    JobInvolvement INT, JobLevel INT, JobRole STRING, JobSatisfaction INT,
    MaritalStatus STRING, MonthlyIncome INT, MonthlyRate INT,
    NumCompaniesWorked INT, Over18 STRING, OverTime STRING,
    PercentSalaryHike INT, PerformanceRating INT,
    RelationshipSatisfaction INT, StandardHours INT, StockOptionLevel INT,
    TotalWorkingYears INT, TrainingTimesLastYear INT, WorkLifeBalance INT,
    YearsAtCompany INT, YearsInCurrentRole INT, YearsSinceLastPromotion INT,
    YearsWithCurrManager INT
"""

# The roles of the employee columns.
EMPLOYEE_NUMERIC = (
    "Age", "DailyRate", "DistanceFromHome", "Education",
    "EnvironmentSatisfaction", "HourlyRate", "JobInvolvement", "JobLevel",
    "JobSatisfaction", "MonthlyIncome", "MonthlyRate", "NumCompaniesWorked",
    "PercentSalaryHike", "PerformanceRating", "RelationshipSatisfaction",
    "StockOptionLevel", "TotalWorkingYears", "TrainingTimesLastYear",
    "WorkLifeBalance", "YearsAtCompany", "YearsInCurrentRole",
    "YearsSinceLastPromotion", "YearsWithCurrManager",
)

EMPLOYEE_CATEGORICAL = (
    "BusinessTravel", "Department", "EducationField", "Gender", "JobRole",
    "MaritalStatus", "OverTime",
)

EMPLOYEE = FeatureSpec(
    numeric=EMPLOYEE_NUMERIC,
    categorical=EMPLOYEE_CATEGORICAL,
    label="Attrition",
    key=("EmployeeNumber",),
)


def employee_schema() -> T.StructType:
    return parse_schema(EMPLOYEE_DDL)
