"""rulewright.streaming"""
