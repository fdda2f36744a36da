"""rulewright.plans"""
