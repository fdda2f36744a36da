"""rulewright: rule reasoning, evaluation statistics and corpus analytics on PySpark."""
