"""rulewright.sources"""
