"""rulewright.operators"""
