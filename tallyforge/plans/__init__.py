"""tallyforge.plans"""
