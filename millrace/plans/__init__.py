from millrace.plans.application import (
    AppConfig,
    Application,
    JobType,
    LakeTable,
    TableInput,
    TopicInput,
    run_application,
)

__all__ = [
    "AppConfig",
    "Application",
    "JobType",
    "LakeTable",
    "TableInput",
    "TopicInput",
    "run_application",
]
