"""rulewright.functions"""
