"""tallyforge.functions"""
